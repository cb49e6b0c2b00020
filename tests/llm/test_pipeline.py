"""The pipeline against a plain-Python version of its stages' decisions, on a small made-up corpus."""

import importlib.util
import pathlib
import types
from collections import Counter

import pytest

import __spark_entry__ as entry
from folioscan.llm.common import staged, table

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    from test_classifiers import corpus

    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels, _ = corpus(300)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, *_ in docs]
    plain = [t for i, t, *_, in rows if i % 5]
    item = " ".join(f"exam{k}" for k in range(14))
    rows += [(400, plain[0], "en", "s0", 1), (401, plain[1] + " more", "en", "s1", 1), (402, plain[2][:150] + " " + item, "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, source string").select("doc_id", "quality", "toxic").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_takes_effect(spark, tables):
    docs, kept = table(spark, tables, "documents"), []
    for name, stage in pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, tables), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(Counter(r["doc_id"] for r in docs.select("doc_id").collect()))
    quality, near, clean, mixed = kept
    assert not [i for i in quality if i < 300 and i % 5 == 0] and len(quality) > 220
    assert set(near) < set(quality) and not {400, 401} & set(near) and 402 in near
    assert set(near) - set(clean) == {402}
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 3
    got = pipeline.run(spark, tables).collect()
    assert Counter(r["doc_id"] for r in got) == mixed
    for k in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_rows_that_are_null_shared_repeated_or_long(spark, tables, tmp_path):
    """Every stage's decisions, against plain versions of them on the stage's own input."""
    from test_dedup import brute_classes
    from test_search_and_format import brute_hits

    base = [(r["doc_id"], r["text"]) for r in table(spark, tables, "documents").select("doc_id", "text").collect()]
    plain = [t for i, t in base if i < 300 and i % 5]
    odd = [(None, plain[3]), (None, plain[4] + " anew"), (None, None), (None, ""), (7, "seven " + plain[5][:200]), (7, plain[6]), (900, " ".join(plain[10:200])), (901, None), (901, plain[8]), (901, plain[8])]
    rows = [(i, t, "en", None if k % 9 == 0 else f"s{k % 3}", k, f"x{k}", 1.5) for k, (i, t) in enumerate(base + odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, contaminated double")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.select("n_chars", "doc_id", "text", "row").distinct().collect()
        docs = staged(stage(spark, docs, tables), name)
        assert docs.columns == columns
        after = Counter(r["n_chars"] for r in docs.select("n_chars").collect())
        if name == "near_dedup":
            classes = brute_classes([(r["n_chars"], r["text"]) for r in before])
            assert set(after.values()) == {1} and len({classes[k] for k in after}) == len(after) == len(set(classes.values()))
        if name == "decontamination":
            hit = {h[0]: h[-1] for h in brute_hits([(r["n_chars"], r["text"]) for r in before], [(1, " ".join(f"exam{k}" for k in range(14)))])}
            assert set(after) == {k for k, bad in hit.items() if not bad}
        if name == "mixing":
            assert max(after.values()) <= 3 and not [r for r in before if not (r["text"] or "").split() and r["n_chars"] in after]
        assert all(r["row"] == f"x{r['n_chars']}" for r in docs.select("row", "n_chars").collect())
    got = pipeline.STAGES[-1][1](spark, docs, tables)
    assert got.columns == [*columns, "size", "text_crc32", "shard", "slot"] and got.count() == docs.count()
    empty = docs.filter("n_chars < 0")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, tables).count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert importlib.util.find_spec("folioscan.llm")


def test_tables_on_the_way_are_removed(spark):
    from folioscan.llm import common

    before = list(common._written)
    out = common.finished(lambda: common.staged(common.staged(spark.range(5), "one").filter("id > 1"), "two"), "three")
    assert out.count() == 3
    (path,) = common._written[len(before) :]
    assert common._written[: len(before)] == before and "three-" in path
    folder = common.shared_dir(spark).removeprefix("file://")
    assert not list(pathlib.Path(folder).glob("one-*")) and not list(pathlib.Path(folder).glob("two-*"))


def test_a_cluster_has_to_name_its_shared_folder():
    from folioscan.llm import common

    session = types.SimpleNamespace(conf={}, sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(session)
    session.conf = {"spark.checkpoint.dir": "hdfs://shared/"}
    assert common.shared_dir(session) == "hdfs://shared"


def test_new_names_are_free_in_any_case():
    from folioscan.llm import common

    assert common.fresh(["Row", "row_", "x"], "row", "y", "y") == ["row__", "y", "y_"]
