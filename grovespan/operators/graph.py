"""Leakage groups, grouped split assignment, and quota selection."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..sources.shared import dropped, saved

#: The split candidates, development / calibration / acceptance in percent.
SPLITS = {"20/30/50": (20, 30, 50), "15/25/60": (15, 25, 60), "10/20/70": (10, 20, 70)}
SPLIT_NAMES = ("development", "calibration", "acceptance")


#: One of so many episodes is looked at for values that very many share: those that this many of them have.
HOT_SAMPLE, HOT = 1024, 64


def shared_edges(relations: DataFrame) -> DataFrame:
    """episode_id, r, v of each (relation, value) that two episodes or more have, once per episode: r is the relation's place by name, v the hash of both.

    Most values join nothing, so they are left out by one sorted stream in which a value's
    episodes are neighbours. Values that very many episodes share (found by a sample, which
    decides only where rows go) stay out of that stream and are kept as they are.
    """
    names = relation_names(relations)
    r = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("relation")), F.lit(0)).cast("int")
    every = relations.where("value <> '' and episode_id is not null").select("episode_id", r.alias("r"), F.xxhash64("relation", "value").alias("v"))
    some = every.where(F.pmod(F.xxhash64("episode_id"), F.lit(HOT_SAMPLE)) == 0)
    hot = saved(some.groupBy("r", "v").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select("r", "v"))
    order = Window.partitionBy("v", "r").orderBy("episode_id")
    once = every.join(F.broadcast(hot), ["r", "v"], "left_anti").withColumn("before", F.lag("episode_id").over(order)).where("before is null or before <> episode_id")
    met = once.withColumn("after", F.lead("episode_id").over(order)).where("before is not null or after is not null")
    return met.select("episode_id", "r", "v").unionByName(every.join(F.broadcast(hot), ["r", "v"], "left_semi").select("episode_id", "r", "v").distinct())


def relation_names(relations: DataFrame) -> list[str]:
    return sorted(x[0] for x in relations.select("relation").where("relation is not null").distinct().collect())


def leakage_groups(relations: DataFrame, most_rounds: int = 60) -> DataFrame:
    """episode_id, group_id, group_size, relations: episodes joined by any shared (relation, value), directly or through others.

    ``relations(episode_id, relation, value)``; null and empty values join nothing.
    Only values that two episodes share take part in the rounds, and only episodes that
    have one; each other episode is a group of its own and passes one shuffle.
    Each round gives every value the least label of its episodes and every episode
    the least of its values, both pre-aggregated, and jumps to the label's own
    label, so rounds grow slowly with the longest chain and a value that very many
    share is no large row. ``relations`` names those of which some value joins
    two episodes of the group, sorted. ``group_id`` is the hash of the sorted episode
    ids; they pass one task as a sorted stream and are never gathered.
    """
    edges = saved(shared_edges(relations))
    labels = saved(edges.select("episode_id").distinct().withColumn("label", F.col("episode_id")))
    for _ in range(most_rounds):
        per_value = edges.join(labels, "episode_id").groupBy("v").agg(F.min("label").alias("label"))
        # Dealt once more: Spark splits a value that many share only where both sides of the join come from an exchange.
        least = edges.join(per_value.repartition(F.xxhash64("v", F.lit(1))), "v").groupBy("episode_id").agg(F.min("label").alias("new"))
        moved = labels.join(least, "episode_id", "left").select("episode_id", "label", F.least("label", F.coalesce("new", "label")).alias("next"))
        jump = labels.select(F.col("episode_id").alias("next"), F.col("label").alias("further"))
        new = saved(moved.join(jump, "next").select("episode_id", F.least("next", "further").alias("label"), F.col("label").alias("was")))
        changed = not new.where("label <> was").isEmpty()
        dropped(labels)
        labels = new.drop("was")
        labels._grovespan_path = new._grovespan_path
        if not changed:
            break
    else:
        raise RuntimeError("leakage groups did not settle")
    sizes = labels.groupBy("label").agg(F.count("*").alias("group_size"))
    relation = F.element_at(F.array(*[F.lit(n) for n in relation_names(relations)]).cast("array<string>"), F.nullif(F.col("r"), F.lit(0)))
    shared = edges.groupBy("r", "v").agg(F.count("*").alias("n"), F.min("episode_id").alias("episode_id")).where("n > 1").withColumn("relation", relation)
    kinds = shared.join(labels, "episode_id").groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"))
    names = labels.select(F.col("label").cast("string").alias("label"), F.col("episode_id").cast("string").alias("e")).repartition("label").sortWithinPartitions("label", "e").mapInArrow(_named, "l string, group_id string")
    out = labels.join(sizes, "label").join(kinds, "label", "left").join(names, F.col("label").cast("string") == F.col("l"))
    joined = out.select("episode_id", "group_id", "group_size", F.coalesce("relations", F.lit("")).alias("relations"))
    alone = relations.select("episode_id").where("episode_id is not null").distinct().join(labels, "episode_id", "left_anti")
    whole = F.array(F.col("episode_id").cast("string"))
    name = text.canonical_text_hash(F.to_json(F.struct(whole.alias("episode_ids")))) if alone.schema["episode_id"].dataType == T.StringType() else text.canonical_hash(("episode_ids", whole))
    return joined.unionByName(alone.select("episode_id", F.concat(F.lit("lmg-"), F.substring(name, 1, 16)).alias("group_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit("").alias("relations")))


def _named(batches):
    """label, e, sorted: the label and the name of each group, from a running hash."""
    last, running = None, None
    done: tuple[list, list] = ([], [])

    def close():
        running.update(b"]}")
        done[0].append(last)
        done[1].append("lmg-" + running.hexdigest()[:16])

    for batch in batches:
        for label, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if label != last:
                if running is not None:
                    close()
                last, running = label, hashlib.sha256(b'{"episode_ids":[')
            else:
                running.update(b",")
            running.update(json.dumps(e).encode())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.string()), pa.array(done[1], pa.string())], ["l", "group_id"])
        done[0].clear()
        done[1].clear()
    if running is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.string()), pa.array(done[1], pa.string())], ["l", "group_id"])


def assign_splits(groups: DataFrame, candidate: str) -> DataFrame:
    """group_id, split of ``groups(group_id, question_type, primary, expanded)``: whole groups dealt greedily, most primary episodes first.

    ``primary`` and ``expanded`` count a group's episodes of a type. A group goes to
    the split whose targets it fills best: the sum over primary episodes, all
    episodes and primary episodes of each of its types of the decrease of
    |target - assigned|, relative to the total; ties go to the larger hash. The
    rule is sequential over groups, so they pass one task as a sorted stream, of which it
    holds a batch and the sums of each split by type; the driver holds the totals by type.
    """
    odd = F.count_if(~F.col("group_id").rlike("^[ -~]*$")).alias("odd")
    sums = groups.groupBy("question_type").agg(F.sum("primary").alias("p"), F.sum("expanded").alias("e"), odd).collect()
    kinds = {x["question_type"]: k for k, x in enumerate(sums)}
    wholes = [float(sum(x["p"] for x in sums)), float(sum(x["e"] for x in sums)), *(float(x["p"]) for x in sums)]
    names = F.create_map(*[F.lit(x) for t, k in kinds.items() if t is not None for x in (t, k)]) if any(t is not None for t in kinds) else F.create_map().cast("map<string,int>")
    kind = F.coalesce(names[F.col("question_type")], F.lit(kinds.get(None, 0)))
    per = groups.withColumn("kind", kind).groupBy("group_id").agg(F.sum("primary").alias("size"), F.sum("expanded").alias("expanded"), F.sort_array(F.collect_list(F.struct("kind", F.col("primary").cast("bigint").alias("n")))).alias("t"))
    # The hash's JSON writes what is not ASCII as escapes, which Spark does not.
    one = (("candidate_id", F.lit(candidate)), ("group_id", F.col("group_id")))
    digest = text.canonical_text_hash(F.to_json(F.struct(*[c.alias(n) for n, c in one]))) if any(x["odd"] for x in sums) else text.canonical_hash(*one)
    # All in one partition by a length that is the same for all: single partitions of several candidates would be run one after the other by one task of their union.
    one_task = F.length("digest") + list(SPLITS).index(candidate)
    stream = per.withColumn("digest", F.unhex(digest)).repartition(2, one_task).sortWithinPartitions(F.desc("size"), "digest").select("group_id", "size", "expanded", F.col("t.kind").alias("kinds"), F.col("t.n").alias("n"))

    def run(batches):
        shares = [x / 100 for x in SPLITS[candidate]]
        targets = [[share * whole for whole in wholes] for share in shares]
        have = [[0.0] * len(wholes) for _ in shares]
        first = f'{{"candidate_id":{json.dumps(candidate)},"group_id":'
        for batch in batches:
            ids, size, expanded = (batch.column(k).to_pylist() for k in range(3))
            at = batch.column(3).offsets.to_pylist()
            types, numbers = batch.column(3).values.to_pylist(), batch.column(4).values.to_pylist()
            shift = batch.column(4).offsets[0].as_py() - at[0]
            out = []
            for i, g in enumerate(ids):
                parts = [(0, size[i]), (1, expanded[i])]
                parts += [(types[j] + 2, numbers[j + shift]) for j in range(at[i], at[i + 1])]
                fills = []
                for goal, own in zip(targets, have):
                    score = 0.0
                    for k, n in parts:
                        if n > 0 and wholes[k] > 0:
                            gap = goal[k] - own[k]
                            score += (abs(gap) - abs(gap - n)) / wholes[k]
                    fills.append(score)
                top = max(fills)
                best = [k for k, x in enumerate(fills) if x == top]
                if len(best) > 1:
                    named = first + json.dumps(g) + ',"split":"'
                    best.sort(key=lambda k: hashlib.sha256(f'{named}{SPLIT_NAMES[k]}"}}'.encode()).hexdigest())
                own = have[best[-1]]
                for k, n in parts:
                    own[k] += n
                out.append(SPLIT_NAMES[best[-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["group_id", "split"])

    return stream.mapInArrow(run, "group_id string, split string")


def quota_sample(rows: DataFrame, quotas: dict[str, int], seed: str) -> DataFrame:
    """Per category the first rows by hash; an episode is taken once, by the categories in the order of ``quotas``.

    A category loses at most as many of its first rows as the ones before it take,
    so its first ``quota`` and that many rows suffice: a number that the quotas
    bound, which one task deals out in order.
    """
    pick = F.sha2(F.concat_ws(":", F.lit(seed), F.col("category"), F.col("episode_id").cast("string")).cast("binary"), 256)
    names, upto, total = list(quotas), {}, 0
    for name, quota in quotas.items():
        total += quota
        upto[name] = total
    most = F.coalesce(*[F.when(F.col("category") == n, F.lit(upto[n])) for n in names])
    first = F.row_number().over(Window.partitionBy("category").orderBy("pick", "episode_id"))
    some = rows.where(F.col("category").isin(names)).withColumn("pick", pick).withColumn("most", most).withColumn("n", first).where("n <= most").drop("most")

    def deal(own: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for name in names:
            mine = own[own["category"] == name].sort_values("n")
            mine = mine[~mine["episode_id"].isin(taken)].drop_duplicates("episode_id").head(quotas[name])
            taken |= set(mine["episode_id"])
            out.append(mine)
        return pd.concat(out).drop(columns=["n"])

    return some.groupBy().applyInPandas(deal, some.drop("n").schema)


def exclusion_reason(rows: DataFrame) -> DataFrame:
    """``rows`` with reason: the exclusion of highest precedence among the flags, null if none.

    Fixed order, highest first: abstention, fewer than four, unrecoverable query,
    exact duplicate, ambiguous support, support not in the haystack, invalid
    answer ids, mismatch of parallel lists, invalid ids.
    """
    order = ("abstention", "fewer_than_four", "unrecoverable_query", "exact_duplicate", "ambiguous_support", "support_not_in_haystack", "invalid_answer_ids", "parallel_mismatch", "invalid_ids")
    return rows.withColumn("reason", F.coalesce(*[F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in order if c in rows.columns]))


def exclusion_reason_v2(rows: DataFrame) -> DataFrame:
    """The same for trajectory questions: answer evidence outside the episode overrides all, then abstention, a missing trajectory, fewer than four, an unrecoverable query."""
    order = ("answer_evidence_not_in_episode", "abstention", "missing_trajectory", "fewer_than_four", "unrecoverable_query")
    return rows.withColumn("reason", F.coalesce(*[F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in order]))


def question_counts(rows: DataFrame) -> DataFrame:
    """question_type, questions, abstentions, eligible of ``rows(question_id, question_type)``."""
    silent = text.is_abstention(F.col("question_id"), F.col("question_type"))
    return rows.groupBy("question_type").agg(F.count("*").alias("questions"), F.count_if(silent).alias("abstentions"), F.count_if(~silent).alias("eligible"))


def context_questions(rows: DataFrame) -> DataFrame:
    """context_id, questions: the sum of question counts, of which a missing one is 1."""
    return rows.groupBy("context_id").agg(F.sum(F.coalesce("question_count", F.lit(1))).cast("bigint").alias("questions"))


def construction_units(rows: DataFrame, dataset: str, exact: int = 10, least: int = 50) -> DataFrame:
    """dataset, units, ten_units (whether there are exactly ``exact``) and the decision whether ``least`` or more replicate."""
    n = rows.groupBy(dataset).agg(F.count("*").alias("units"))
    return n.withColumn("ten_units", F.col("units") == exact).withColumn("decision", F.when(F.col("units") >= least, "replicate").otherwise("descriptive_only"))


def layout(supports: DataFrame) -> DataFrame:
    """episode_id, support_class, position_bin of ``supports(episode_id, position, leaf, n)``.

    The bin is that of mean(position) / max(1, n - 1): below a third early, below
    two thirds middle, else late; support over more than one leaf is multiple.
    """
    own = supports.groupBy("episode_id").agg(F.avg("position").alias("p"), F.max("n").alias("n"), F.min("leaf").alias("a"), F.max("leaf").alias("z"))
    center = F.col("p") / F.greatest(F.lit(1), F.col("n") - 1)
    place = F.when(center < F.lit(1 / 3), "early").when(center < F.lit(2 / 3), "middle").otherwise("late")
    return own.select("episode_id", F.when(F.col("a") == F.col("z"), "single").otherwise("multiple").alias("support_class"), place.alias("position_bin"))


def eligibility(evidence: DataFrame, ks: tuple[int, ...] = (4, 8, 16)) -> DataFrame:
    n = evidence.groupBy("episode_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))
    return n.select("episode_id", "n", "tokens", *[(F.col("n") >= k).alias(f"eligible_k{k}") for k in ks])


def eligibility_counts(evidence: DataFrame, ks: tuple[int, ...] = (4, 8, 16)) -> DataFrame:
    return eligibility(evidence, ks).agg(F.count_if(F.col("n") >= min(ks)).alias("n_master"), *[F.count_if(F.col(f"eligible_k{k}")).alias(f"n{k}") for k in ks])


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that are in one of two sets only, with the side: empty if the sets are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def near_text_pairs(rows: DataFrame, least: float) -> DataFrame:
    """a, b, likeness of items whose sets of normalised words have a Jaccard likeness of ``least`` or more.

    Prefix filtering: of two such sets, the first |x| - ceil(least |x|) + 1 words by
    rarity share one, so items meet by their rare words only and a common word
    joins nothing but sets that are small.
    """
    words = rows.select("item", F.explode(F.array_distinct(F.split(text.normalized_answer(F.col("text")), " "))).alias("t"))
    often = words.groupBy("t").agg(F.count("*").alias("f"))
    ranked = words.join(often, "t").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("w"))
    ranked = saved(ranked.select("item", F.transform("w", lambda x: x["t"]).alias("w"), F.size("w").alias("n")))
    front = ranked.select("item", "n", F.explode(F.slice("w", 1, (F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).cast("int"))).alias("t"))
    met = front.alias("a").join(front.alias("b"), "t").where("a.item < b.item and least(a.n, b.n) >= " + repr(least) + " * greatest(a.n, b.n)").select(F.col("a.item").alias("a"), F.col("b.item").alias("b")).distinct()
    both = met.join(ranked.select(F.col("item").alias("a"), F.col("w").alias("wa")), "a").join(ranked.select(F.col("item").alias("b"), F.col("w").alias("wb")), "b")
    same = F.size(F.array_intersect("wa", "wb"))
    return both.select("a", "b", (same / (F.size("wa") + F.size("wb") - same)).alias("likeness")).where(F.col("likeness") >= least)


def first_per_group(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
