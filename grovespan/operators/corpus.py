"""Audit of a corpus of three files: questions, the haystack of each, and trajectories.

Each file is dealt once, when it is written as a bucketed table: questions and haystacks
by question, haystack entries and trajectories by trajectory and a salt. The joins of
the audit then read their sides bucket by bucket, without an exchange. The salt is a
hash of the question for a trajectory that more than ``HOT`` haystack entries name, else 0;
of trajectories only a few measures per row are kept, and these are written once per salt,
so one trajectory that a third of all haystacks hold is in ``SALTS`` buckets, and any other
is written once. Texts and hashes of a trajectory are read once, however many haystacks
hold it. Tables are written when they are first read. Of a trajectory they have only the
measures that are asked for, and its hash where its id is repeated, to tell the first.
Shuffle files go with each write, and a file that the audit owns with the table made of it.

Nothing is dropped in silence: every question is normalised or excluded with a reason,
and rows that make the files unusable (ids that are missing or repeated, haystacks
without question or the reverse) are in ``problems``, where the status becomes blocked.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import json_rows
from ..sources.shared import deleted, dropped, saved, shared_folder, shuffles_freed
from . import graph

BUCKETS, SALTS, HOT = 16, 8, 64
#: Categories of the primary analysis, sizes a question must reach, shares of the splits.
PRIMARY = ("knowledge-update", "temporal-reasoning")
LEAST, SIZES = 4, (4, 8, 16)
SHARES = (0.2, 0.3)
MEASURES = ("event_time", "token_count", "raw_sha256")
#: What is kept of a judged question where its texts and ids are not asked for.
VERDICT = ("question_id", "question_type", "n", "tokens", "lost", "support_class", "position_bin", "primary", "abstention", "reason")

QUESTION = "id string, question_id string, question_type string, question string, answer string, eval_function string, domain string, environment string, family_id string, answer_session_ids array<string>, supporting_evidence_ids array<string>, evidence_ids array<string>, evidence_trajectory_ids array<string>"
TRAJECTORY = "id string, trajectory_id string, question_id string, current_time string, event_time string, messages array<struct<role: string, content: string>>, states array<struct<thought: string, accessibility_tree: string, action: string, url: string>>, content string, goal string"


def bucketed(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``rows`` as a table in the shared folder, dealt into buckets by ``keys`` and sorted by them."""
    spark = rows.sparkSession
    name = f"grovespan_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    with shuffles_freed(spark):
        rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.table(name)
    out._grovespan_table = name, path
    return out


def read(spark: SparkSession, questions: str, haystacks: str, trajectories: str, split_bytes: int = json_rows.SPLIT_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three files: questions and trajectories with a JSON object a line, haystacks as one object from question to trajectories.

    Blank lines are skipped, malformed ones fail. ``id`` is the first non-empty of three names; ``raw`` is a trajectory's line.
    """
    first = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("id", "question_id", "trajectory_id")])

    def lines(path: str, schema: str) -> DataFrame:
        rows = spark.read.text(path).where(F.trim("value") != "")
        return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"), F.col("value").alias("raw")).select("row.*", "raw")

    asked = lines(questions, QUESTION).withColumn("trajectory_id", F.lit(None).cast("string")).withColumn("id", first).drop("trajectory_id", "question_id", "raw")
    held = json_rows.read_map(spark, haystacks, "array<string>", split_bytes).select(F.col("key").alias("question_id"), F.col("value").alias("evidence_ids"))
    return asked, held, lines(trajectories, TRAJECTORY).withColumn("id", first).drop("question_id", "trajectory_id")


def trajectory_measures(trajectories: DataFrame) -> DataFrame:
    """trajectory_id, event_time, token_count, raw_sha256 (of the canonical JSON) of each trajectory."""
    body = text.trajectory_text(F.col("messages"), F.col("states"), F.col("content"), F.col("goal"))
    time = F.coalesce(F.nullif(F.col("current_time"), F.lit("")), F.col("event_time"))
    return trajectories.select(F.col("id").alias("trajectory_id"), time.alias("event_time"), text.evidence_tokens(body).alias("token_count"), text.canonical_text_hash("raw").alias("raw_sha256"))


def _numbered(trajectories: DataFrame) -> DataFrame:
    """trajectory_id, n: rows of each id of the trajectories' table."""
    return trajectories.where("salt = 0").groupBy("trajectory_id", "salt").agg(F.count("*").alias("n"))


def _code(rows: DataFrame, name: str, problem: str) -> DataFrame:
    return rows.select(F.col(name).alias("id"), F.lit(problem).alias("problem"))


class Audit:
    """The audit's tables, each a DataFrame; what several of them read is written once.

    ``measures``: the trajectories' measures that are wanted; ``evidence`` needs all.
    ``owned``: paths of the files of questions, haystacks and trajectories, if the audit is
    to delete each once its table is written.
    """

    def __init__(self, questions: DataFrame, haystacks: DataFrame, trajectories: DataFrame, buckets: int = BUCKETS, measures: tuple[str, ...] = MEASURES, owned: tuple[str, ...] = ()):
        self._rows, self._buckets, self._measures, self._owned = (questions.withColumnRenamed("id", "question_id").withColumnRenamed("evidence_ids", "named_evidence_ids"), haystacks, trajectories), buckets, measures, owned
        self._tables: list[tuple[str, str]] = []
        self._small: list[DataFrame] = []

    def _bucketed(self, rows: DataFrame, *keys: str) -> DataFrame:
        out = bucketed(rows, list(keys), self._buckets)
        self._tables.append(out._grovespan_table)
        return out

    def _read_whole(self, place: int) -> None:
        """A file of which a table was written is not read again."""
        if self._owned:
            deleted(self._rows[place].sparkSession, self._owned[place])

    def release(self) -> None:
        """Delete files and tables; only ``conversion``, ``strata`` and ``distributions``, and what was saved, can be read then."""
        spark = self._rows[0].sparkSession
        for name, path in self._tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            deleted(spark, path)
        for path in self._owned:
            deleted(spark, path)
        for rows in self._small:
            dropped(rows)

    @functools.cached_property
    def questions(self) -> DataFrame:
        out = self._bucketed(self._rows[0], "question_id")
        self._read_whole(0)
        return out

    @functools.cached_property
    def haystacks(self) -> DataFrame:
        out = self._bucketed(self._rows[1], "question_id")
        self._read_whole(1)
        return out

    @functools.cached_property
    def hot(self) -> DataFrame:
        """trajectory_id of those that more than ``HOT`` haystack entries name: at most one for every ``HOT`` entries."""
        named = self.haystacks.select(F.explode("evidence_ids").alias("trajectory_id")).where("trajectory_id is not null")
        with shuffles_freed(named.sparkSession):
            out = saved(named.groupBy("trajectory_id").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("trajectory_id", F.lit(True).alias("hot")))
        self._small.append(out)
        return out

    @functools.cached_property
    def trajectories(self) -> DataFrame:
        """The measures that are wanted, once per salt; raw_sha256 is binary here and, where it is not wanted, null but for repeated ids."""
        salts = F.when(F.col("hot"), F.array(*[F.lit(k) for k in range(SALTS)])).otherwise(F.array(F.lit(0)))
        measures = trajectory_measures(self._rows[2])
        hashed = F.unhex("raw_sha256")

        def dealt(rows: DataFrame, raw: Column) -> DataFrame:
            kept = rows.select("trajectory_id", *(c for c in self._measures if c != "raw_sha256"), raw.cast("binary").alias("raw_sha256"))
            return self._bucketed(kept.join(self.hot, "trajectory_id", "left").withColumn("salt", F.explode(salts)).drop("hot"), "trajectory_id", "salt")

        if "raw_sha256" in self._measures:
            out = dealt(measures, hashed)
        else:
            out = dealt(measures, F.lit(None))
            again = saved(_numbered(out).where("trajectory_id is not null and n > 1").select("trajectory_id", F.lit(True).alias("again")))
            self._small.append(again)
            if not again.isEmpty():
                out = dealt(measures.join(again, "trajectory_id", "left"), F.when(F.col("again"), hashed))
                name, path = self._tables.pop(-2)
                out.sparkSession.sql(f"DROP TABLE {name}")
                deleted(out.sparkSession, path)
        self._read_whole(2)
        return out

    @functools.cached_property
    def entries(self) -> DataFrame:
        rows = self.haystacks.select("question_id", F.posexplode("evidence_ids").alias("sequence_index", "trajectory_id")).join(self.hot, "trajectory_id", "left")
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("question_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
        return self._bucketed(rows.withColumn("salt", salt).select("question_id", "sequence_index", "trajectory_id", "salt"), "trajectory_id", "salt")

    def placed(self) -> DataFrame:
        """Each haystack entry with the measures of its trajectory that are wanted, null where there is none; a repeated trajectory counts by its first row."""
        own = [c for c in MEASURES if c in self._measures]
        first = F.min(F.struct("raw_sha256", *(c for c in own if c != "raw_sha256"))).alias("t")
        known = self.trajectories.groupBy("trajectory_id", "salt").agg(first)
        both = self.entries.join(known, ["trajectory_id", "salt"], "left")
        columns = [F.lower(F.hex("t.raw_sha256")).alias(c) if c == "raw_sha256" else F.col(f"t.{c}") for c in own]
        return both.select("question_id", F.col("sequence_index").cast("bigint").alias("sequence_index"), F.col("trajectory_id").alias("evidence_id"), *columns, F.col("t").isNotNull().alias("known"))

    def problems(self) -> DataFrame:
        """id, problem that block the audit. Where no table was written yet, only the ids are read."""
        known = vars(self)
        asked = known["questions"] if "questions" in known else self._bucketed(self._rows[0].select("question_id"), "question_id")
        bad = F.col("evidence_ids").isNull() | F.exists("evidence_ids", lambda x: x.isNull())
        held = known["haystacks"].select("question_id", bad.alias("bad")) if "haystacks" in known else self._bucketed(self._rows[1].select("question_id", bad.alias("bad")), "question_id")
        keys = asked.join(held.select("question_id", F.lit(True).alias("held")), "question_id", "left").where("held is null")
        more = held.join(asked, "question_id", "left_anti")
        out = _code(keys, "question_id", "no_haystack").unionByName(_code(more, "question_id", "unknown_question"))
        told = _numbered(known["trajectories"]) if "trajectories" in known else self._rows[2].groupBy(F.col("id").alias("trajectory_id")).agg(F.count("*").alias("n"))
        for n, key, name in ((asked.groupBy("question_id").agg(F.count("*").alias("n")), "question_id", "question"), (held.groupBy("question_id").agg(F.count("*").alias("n")), "question_id", "haystack"), (told, "trajectory_id", "trajectory")):
            kind = F.when(F.col(key).isNull(), f"{name}_without_id").otherwise(f"repeated_{name}")
            out = out.unionByName(n.where(F.col(key).isNull() | (F.col("n") > 1)).select(F.col(key).alias("id"), kind.alias("problem")))
        return out.unionByName(_code(held.where("bad"), "question_id", "invalid_haystack"))

    def _flagged(self) -> DataFrame:
        lost = F.when(~F.col("known"), F.struct("sequence_index", "evidence_id")).alias("lost")
        # Dealt as the tables of questions and haystacks are, so their join needs no exchange.
        per = self.placed().select("question_id", "token_count", lost).repartition(self._buckets, "question_id").groupBy("question_id").agg(F.sum("token_count").alias("tokens"), F.sort_array(F.collect_list("lost")).alias("lost"))
        support = text.answer_evidence(*[F.col(c) for c in ("answer_session_ids", "supporting_evidence_ids", "named_evidence_ids", "evidence_trajectory_ids")])
        rows = self.questions.join(self.haystacks, "question_id").withColumn("support", support).join(per, "question_id", "left")
        kind = F.coalesce("question_type", F.lit("unknown"))
        silent = text.is_abstention(F.col("question_id"), kind)
        # Places of the support's first occurrences.
        places = F.array_distinct(F.filter(F.transform("support", lambda x: F.array_position("evidence_ids", x) - 1), lambda p: p >= 0))
        found = F.filter(F.transform("support", lambda x: F.array_position("evidence_ids", x) - 1), lambda p: p >= 0)
        center = F.aggregate(found, F.lit(0.0), lambda s, p: s + p) / F.size(found) / F.greatest(F.lit(1), F.size("evidence_ids") - 1)
        bin_ = F.when(F.size(found) == 0, "unknown").when(center < F.lit(1 / 3), "early").when(center < F.lit(2 / 3), "middle").otherwise("late")
        flagged = rows.select(
            "question_id", kind.alias("question_type"), "question", "answer", "eval_function", "domain", "environment", "family_id", "evidence_ids", "support",
            F.size("evidence_ids").cast("bigint").alias("n"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.transform("lost", lambda x: x["evidence_id"]).alias("lost"), F.when(F.size(places) > 1, "multiple").otherwise("single_or_unknown").alias("support_class"), bin_.alias("position_bin"),
            kind.isin(*PRIMARY).alias("primary"), silent.alias("abstention"), (F.size("lost") > 0).alias("missing_trajectory"), (F.size("evidence_ids") < LEAST).alias("fewer_than_four"),
            ((F.coalesce("question", F.lit("")) == "") | F.col("answer").isNull() | (F.coalesce("eval_function", F.lit("")) == "")).alias("unrecoverable_query"),
            (F.size(F.array_except("support", "evidence_ids")) > 0).alias("answer_evidence_not_in_episode"),
        )
        reason = F.when(F.col("reason") == "missing_trajectory", F.concat(F.lit("missing_trajectory:"), F.array_join(F.slice("lost", 1, 5), ","))).otherwise(F.col("reason"))
        return graph.exclusion_reason_v2(flagged).withColumn("reason", reason)

    def judged(self) -> DataFrame:
        """Every question that has a haystack, its haystack's measures, support and the reason why it is excluded, null if it is not."""
        if not hasattr(self, "_judged"):
            with shuffles_freed(self._rows[0].sparkSession):
                self._judged = saved(self._flagged())
        return self._judged

    def verdicts(self) -> DataFrame:
        """The columns ``VERDICT`` of ``judged``; where that was not written, only they are."""
        if not hasattr(self, "_verdicts"):
            with shuffles_freed(self._rows[0].sparkSession):
                self._verdicts = self._judged.select(*VERDICT) if hasattr(self, "_judged") else saved(self._flagged().select(*VERDICT))
        return self._verdicts

    def episodes(self) -> DataFrame:
        """The normalised questions with eligibility, family and the hash of what is recorded of them."""
        own = self.judged().where("reason is null")
        family = F.coalesce(F.nullif(F.col("family_id"), F.lit("")), F.concat_ws(":", F.coalesce("domain", F.lit("unknown")), F.coalesce("environment", F.lit("unknown")), "question_id"))
        rows = own.select(F.col("question_id").alias("episode_id"), "question_type", "primary", family.alias("family_id"), "question", "answer", "eval_function", "evidence_ids", "support", "n", *[(F.col("n") >= k).alias(f"eligible_k{k}") for k in SIZES], "tokens", "support_class", "position_bin")
        return rows.withColumn("artifact_hash", text.canonical_text_hash(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})))

    def evidence(self) -> DataFrame:
        """The evidence of the normalised questions, one row per place."""
        kept = self._bucketed(self.verdicts().where("reason is null").select("question_id"), "question_id")
        return self._bucketed(self.placed(), "question_id").join(kept, "question_id", "left_semi").drop("known").withColumnRenamed("question_id", "episode_id")

    def conversion(self) -> DataFrame:
        """question_id, status, reason, missing: one row for every question that has a haystack."""
        status = F.when(F.col("reason").isNull(), "normalized").otherwise("excluded")
        return self.verdicts().select("question_id", "question_type", status.alias("status"), "reason", F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("missing"))

    def answer_mapping(self) -> DataFrame:
        own = self.judged().where("reason is null")
        return own.select("question_id", F.col("support").alias("answer_session_ids"), F.when(F.size("support") > 0, "available").otherwise("not_provided_by_source").alias("mapping_status"))

    def strata(self) -> DataFrame:
        """question_type, support_class, position_bin, primary, n."""
        return self.verdicts().where("reason is null").groupBy("question_type", "support_class", "position_bin", "primary").agg(F.count("*").alias("n"))

    def distributions(self) -> DataFrame:
        """measure, n, least, p50, p95, most, mean: haystack sizes of all questions and tokens of normalised ones, by nearest rank (halves to even)."""
        rows = self.verdicts().select("question_id", F.explode(F.array(
            F.struct(F.lit("sessions").alias("measure"), F.col("n").alias("x")),
            F.struct(F.when(F.col("reason").isNull(), "tokens").alias("measure"), F.col("tokens").alias("x")),
        )).alias("m")).select("m.measure", "m.x").where("measure is not null")
        # Values with their numbers, so that a window sees distinct values only.
        counts = rows.groupBy("measure", "x").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("measure").orderBy("x"))
        total = F.sum("c").over(Window.partitionBy("measure"))
        ranked = counts.withColumn("upto", upto).withColumn("total", total)

        def at(share: float) -> Column:
            place = F.bround((F.col("total") - 1) * F.lit(share), 0)
            return F.min(F.when(F.col("upto") > place, F.col("x")))

        return ranked.groupBy("measure").agg(F.max("total").alias("n"), F.min("x").alias("least"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("x").alias("most"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"))

    def counts(self) -> DataFrame:
        """One row: totals, eligibility by size, split sizes (halves to even), whether nothing was dropped, and the status."""
        own, primary = F.col("reason").isNull(), F.col("primary")
        sums = self.verdicts().agg(
            F.count("*").alias("converted"), F.count_if(own).alias("n_master"), F.count_if(~own).alias("excluded"), F.count_if("abstention").alias("abstentions"),
            *[F.count_if(own & (F.col("n") >= k)).alias(f"n{k}") for k in SIZES],
            F.count_if(own & primary).alias("primary_n_master"), *[F.count_if(own & primary & (F.col("n") >= k)).alias(f"primary_n{k}") for k in SIZES],
        )
        asked = self.questions.agg(F.count("*").alias("questions"))
        bad = self.problems().agg(F.count("*").alias("problems"))
        # Three rows, each with columns of its own, into one.
        three = asked.unionByName(bad, allowMissingColumns=True).unionByName(sums, allowMissingColumns=True)
        out = three.agg(*[F.max(c).alias(c) for c in three.columns])
        for name, n in (("", "primary_n_master"), ("expanded_", "n_master")):
            dev, cal = (F.bround(F.col(n) * F.lit(s), 0).cast("bigint") for s in SHARES)
            out = out.withColumns({f"{name}development": dev, f"{name}calibration": cal}).withColumn(f"{name}acceptance", F.col(n) - F.col(f"{name}development") - F.col(f"{name}calibration"))
        status = F.when((F.col("problems") > 0) | (F.col("primary_n_master") == 0), "blocked").when(F.col("excluded") > 0, "qualified_with_exclusions").otherwise("qualified")
        return out.withColumn("no_silent_drop", F.col("converted") == F.col("questions")).withColumn("status", status)
