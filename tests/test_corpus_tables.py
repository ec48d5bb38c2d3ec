"""What the audit writes: trajectories once but for hot ones, files compressed, tables only where they are read."""

from test_corpus import audited, question, write

from grovespan.operators import corpus
from grovespan.plans import corpora


def test_trajectories_are_written_once_but_for_hot_ones(spark, tmp_path):
    haystacks = {f"q{k}": ["hot", f"t{k}", f"t{k + 1}", f"t{k + 2}", None] for k in range(corpus.HOT + 1)}
    write(tmp_path, [question(k) for k in haystacks], haystacks, [{"id": f"t{j}", "content": "x"} for j in range(100)] + [{"id": "hot"}, {"goal": "no id"}])
    audit = audited(spark, tmp_path)
    assert audit.trajectories.count() == 101 + corpus.SALTS
    assert {r["trajectory_id"] for r in audit.entries.where("salt > 0").collect()} == {"hot"}
    placed = audit.placed().where("evidence_id is not null")
    assert placed.count() == placed.where("known and length(raw_sha256) = 64").count() == 4 * len(haystacks)


def test_problems_write_no_entries(spark, tmp_path):
    write(tmp_path, [question("a")], {"a": ["t"]}, [{"id": "t"}])
    audit = audited(spark, tmp_path)
    assert audit.problems().count() == 0 and "entries" not in vars(audit)


def test_trajectory_files_are_compressed(spark, data, tmp_path):
    corpora.files(spark, data, str(tmp_path))
    for name in ("questions", "trajectories"):
        assert list((tmp_path / f"{name}.jsonl").glob("part-*.json.gz"))
