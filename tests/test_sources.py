"""JSON documents, numbered lines, SQL functions and read-back of uncapped files."""

import json
import random

import pytest

from postlake.functions import sql
from postlake.functions import text as X
from postlake.operators import model
from postlake.sources import files, lines, variants


def strings(v):
    """Depth first, fields by name."""
    if isinstance(v, str):
        return [v.strip(" ")] if len(v.strip(" ")) > 3 else []
    if isinstance(v, dict):
        return [s for k in sorted(v) for s in strings(v[k])]
    return [s for x in v for s in strings(x)] if isinstance(v, list) else []


def made(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.35:
        return r.choice([" plain words ", "abc", "four", "", 7, 1.5, None, True, "ünïcode", 'quote " and \\ slash', "x" * 300])
    if kind < 0.65:
        return [made(r, depth - 1) for _ in range(r.randint(0, 12))]
    return {f"{r.choice('zyab')}{i}": made(r, depth - 1) for i in range(r.randint(0, 4))}


def test_strings_of_nested_documents(spark):
    r = random.Random(4)
    docs = [(i, json.dumps(made(r, 5), ensure_ascii=False)) for i in range(60)]
    deep = "bottom"
    for _ in range(150):
        deep = [deep]
    docs += [(100, json.dumps(deep)), (101, "{broken"), (102, None), (103, '"only"'), (104, ""), (105, "[]")]
    df = spark.createDataFrame(docs, "id int, j string").repartition(4)
    good = {i: strings(json.loads(j)) for i, j in docs if j and i not in (101, 104)}
    got = {}
    for x in sorted(variants.json_strings(df, "id", "j").collect()):
        assert x.pos == len(got.setdefault(x.id, [])) + 1
        got[x.id].append(x.text)
    assert got == {i: s for i, s in good.items() if s} and got[100] == ["bottom"]
    read = {x.id: x for x in variants.read_json_documents(df, "id", "j", rows=2).collect()}
    assert len(read) == len(docs) and {i for i, x in read.items() if not x.success} == {101, 102, 104}
    for i, s in good.items():
        assert (read[i].text, read[i].items_extracted) == ("\n".join(s[:2]), len(s))


def test_more_strings_than_the_usual_limit_of_recursion(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        df = spark.createDataFrame([(1, json.dumps([f"item {i}" for i in range(400)]))], "id int, j string")
        assert variants.json_strings(df, "id", "j").count() == 400
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


@pytest.mark.parametrize("split", ["64", "1000", "1m"])
def test_files_zip_by_line_whatever_their_splits(spark, tmp_path, split):
    r = random.Random(1)
    texts = [("é" * r.randint(0, 40) + f" t{i}") if r.random() < 0.9 else "" for i in range(300)]
    labels = [r.choice(["0", "1", "2", " 2 ", "9", "x", ""]) for _ in range(290)]
    (tmp_path / "t.txt").write_text("\n".join(texts) + "\n", encoding="utf-8")
    (tmp_path / "l.txt").write_text("\n".join(labels), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {x.line: (x.text, x.label) for x in lines.zip_files(spark, str(tmp_path / "t.txt"), str(tmp_path / "l.txt")).collect()}
        pairs = {x.line: (x.text, x.label) for x in lines.label_pairs(spark, str(tmp_path / "t.txt"), str(tmp_path / "l.txt")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    held = labels[: len(labels) - 1] if labels[-1] == "" else labels
    assert got == {i: (t, held[i] if i < len(held) else None) for i, t in enumerate(texts)}
    names = {"0": "negative", "1": "neutral", "2": "positive"}
    assert pairs == {i: (t.strip(), names[x.strip()]) for i, (t, x) in enumerate(zip(texts, held)) if x.strip() in names and t.strip()}


def test_functions_in_sql_text(spark):
    sql.register(spark)
    rows = [(1, "Great app, but SLOW though. yet", "ctx  One"), (2, None, None), (3, "RT @me: see https://x.org/a  now", ""), (4, "खूप छान पण हळू", None), (5, " , ;", None)]
    df = spark.createDataFrame(rows, "post_id bigint, text string, context string")
    df.createOrReplaceTempView("few")
    want = sorted((x.post_id, i, c.strip(" ")) for x in df.select("post_id", X.clauses(df["text"]).alias("c")).collect() for i, c in enumerate([y for y in x.c or [] if y.strip(" ")]))
    one = spark.sql("SELECT f.post_id, c.pos, c.clause FROM few f, LATERAL split_clauses(f.text) c").collect()
    whole = spark.sql("SELECT * FROM split_clauses(TABLE(SELECT post_id, text FROM few))").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, whole)) == want and len(want) >= 5
    keys = spark.sql("SELECT post_id, cache_key(text, context) AS k FROM few").collect()
    assert dict(keys) == dict(df.select("post_id", model.cache_key(df["text"], df["context"])).collect())


def test_files_are_read_whole_unless_asked(spark):
    raw = "\n".join(f"a{i}, b{i}" for i in range(700)).encode()
    assert files.read_csv(raw)[0].count("\n") == 699 and files.read_csv(raw, 500)[0].count("\n") == 499
    assert files.read_csv(raw, 500)[1] == {"row_count": 700}
    df = spark.createDataFrame([("x.json", bytearray(json.dumps([f"item {i}" for i in range(600)]).encode()))], "path string, content binary")
    assert files.extract_documents(df).first().text.count("\n") == 599
    assert files.extract_documents(df, 10).first().text.count("\n") == 9


def test_files_are_read_a_few_at_a_time_whatever_the_batch(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(files, "ROWS", 3)
    monkeypatch.setattr(files, "BYTES", 10)
    b = pa.RecordBatch.from_arrays([pa.array(list("abcdefgh")), pa.array([b"x" * 4, None, b"", b"x", b"x" * 30, b"x" * 6, b"x" * 4, b"x"])], names=["path", "content"])
    parts = [s.column(0).to_pylist() for s in files._slices(b)]
    assert parts == [["a", "b", "c"], ["d"], ["e"], ["f", "g"], ["h"]] and not list(files._slices(b.slice(0, 0)))
    got = files.extract_documents(spark.createDataFrame([("a.txt", b" h\xc3\xa9 "), ("b.json", b"{"), ("c.pdf", None), ("d.csv", b"a,b\n")], "path string, content binary")).collect()
    assert [(r.path, r.format, r.text, r.success, r.metadata) for r in got[:1]] == [("a.txt", "text", "hé", True, {"char_count": "2"})]
    assert [r.success for r in got] == [True, False, False, True] and got[3].metadata == {"row_count": "1"} and got[1].page_count == 0
