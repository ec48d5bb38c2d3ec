"""What the audit leaves on disk, and that results do not change by it: slices, narrow tables, repeated ids, files that go."""

import gzip
import json
import time

import pytest
from test_corpus import question, write

from grovespan.operators import corpus
from grovespan.plans import corpora
from grovespan.sources import shared


@pytest.fixture
def folder(tmp_path, monkeypatch):
    """A shared folder of the test's own."""
    own = tmp_path / "shared"
    own.mkdir()
    for module in (shared, corpus, corpora):
        monkeypatch.setattr(module, "shared_folder", lambda spark: f"file://{own}")
    return own


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f}


def test_shuffle_files_go_with_the_write(spark, folder):
    before = shuffle_files(spark)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    told = spark.conf.get(setting)
    written = corpus.bucketed(spark.range(1000).toDF("x"), ["x"], 3)
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(setting) == told
    assert written.count() == 1000


def test_slices_make_the_same_trajectories(spark, data, tmp_path, monkeypatch):
    def lines(name):
        corpora.files(spark, data, str(tmp_path / name))
        return sorted(x for f in (tmp_path / name / "trajectories.jsonl").glob("part-*.gz") for x in gzip.open(f, "rt", encoding="utf-8"))

    whole = lines("one")
    monkeypatch.setattr(corpora, "SLICE_BYTES", 40_000)
    dealt = []
    add = corpora._trajectories
    monkeypatch.setattr(corpora, "_trajectories", lambda table, path: (dealt.append(table.count()), add(table, path)))
    assert lines("many") == whole and len({json.loads(x)["id"] for x in whole}) == len(whole)
    assert len(dealt) > 2 and sum(dealt) == spark.read.parquet(f"{data}/lineitem.parquet").count()


@pytest.mark.parametrize("name", ["conversion", "strata", "distributions", "problems", "counts"])
def test_only_what_is_returned_stays(spark, data, folder, name):
    rows = getattr(corpora, f"three_file_{name}")(spark, data).collect()
    assert rows and len({p.parent for p in folder.rglob("*.parquet")}) == 1
    assert not list(folder.rglob("part-*.json*")) and not list(folder.rglob("part-*.txt"))


def test_a_repeated_trajectory_counts_by_its_first_row_in_a_narrow_table(spark, tmp_path):
    trajectories = [{"id": f"t{k}", "content": "x " * n} for k in range(12) for n in (1 + k, 20 - k, 7)] + [{"id": "a", "content": "one"}, {"goal": "no id"}, {"goal": "none"}]
    write(tmp_path, [question(f"q{k}") for k in range(12)], {f"q{k}": [f"t{k}", "a", "a", "lost"] for k in range(12)}, trajectories)
    files = [str(tmp_path / n) for n in ("q.jsonl", "h.json", "t.jsonl")]
    wide, narrow = (corpus.Audit(*corpus.read(spark, *files), buckets=3, measures=m) for m in (corpus.MEASURES, ("token_count",)))
    tell = lambda a: sorted((r["question_id"], r["tokens"], r["reason"]) for r in a.verdicts().collect())
    assert tell(narrow) == tell(wide) and len({n for _, n, _ in tell(wide)}) > 2
    assert narrow.trajectories.where("raw_sha256 is not null").count() == 36
    assert narrow.counts().first() == wide.counts().first()
    problems = lambda a: sorted(map(str, a.problems().collect()))
    unwritten = corpus.Audit(*corpus.read(spark, *files), buckets=3)
    assert problems(narrow) == problems(wide) == problems(unwritten) and len(problems(wide)) == 13


def test_problems_read_ids_only(spark, tmp_path):
    write(tmp_path, [question("a"), question("b")], {"a": ["t", None], "c": ["t"]}, [{"id": "t"}, {"id": "t"}])
    audit = corpus.Audit(*corpus.read(spark, *[str(tmp_path / n) for n in ("q.jsonl", "h.json", "t.jsonl")]), buckets=3)
    assert sorted(map(tuple, audit.problems().collect())) == [("a", "invalid_haystack"), ("b", "no_haystack"), ("c", "unknown_question"), ("t", "repeated_trajectory")]
    assert not {"questions", "haystacks", "trajectories", "hot"} & set(vars(audit))
    assert sorted(c for name, _ in audit._tables for c in spark.table(name).columns) == ["bad", "question_id", "question_id"]


def test_verdicts_are_those_of_judged(spark, tmp_path):
    write(tmp_path, [question(f"q{k}", evidence_ids=["t1"]) for k in range(20)], {f"q{k}": [f"t{j}" for j in range(k)] for k in range(20)}, [{"id": f"t{j}", "content": "x " * j} for j in range(17)])
    one, two = (corpus.Audit(*corpus.read(spark, *[str(tmp_path / n) for n in ("q.jsonl", "h.json", "t.jsonl")]), buckets=3) for _ in range(2))
    judged = one.judged().select(*corpus.VERDICT)
    assert sorted(map(str, judged.collect())) == sorted(map(str, two.verdicts().collect())) == sorted(map(str, one.verdicts().collect()))
    assert two.verdicts().columns == list(corpus.VERDICT) and not hasattr(two, "_judged")
