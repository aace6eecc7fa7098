import pytest

from shotlab.operators.vocab import user_vocab
from shotlab.sources.checked import REASONS, checked_scan


def tally(**n):
    return {r: n.get(r.replace(" ", "_"), 0) for r in REASONS} | {"rows": n["rows"]}


def test_json_lines(spark, tmp_path):
    lines = ['{"doc_id": 1, "text": "a", "label": 0}', '{"doc_id": 2, "text": "", "label": "1"}', '{"doc_id": 3, "text": null, "label": 1}', '{"doc_id": 4, "text": "d"}',
             '{"doc_id": 5, "text": "e", "label": 2}', '{"doc_id": "x", "text": "f", "label": 0}', '{"doc_id": 7, "text": "bro', '{"doc_id": 1, "text": "a", "label": 0}', '{"doc_id": 8, "text": "g", "label": -1}']
    (tmp_path / "rows.json").write_text("\n".join(lines))
    c = checked_scan(spark, str(tmp_path / "rows.json"), 2, fmt="json")
    rows, rejects = c.split(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.label_idx) for r in rows.collect()) == [(1, "a", 0), (1, "a", 0), (2, "", 1)]
    assert {r.split for r in rows.collect()} <= {"train", "test"}
    got = {(r.raw_id, r.reason) for r in rejects.collect()}
    assert got >= {("3", "no text"), ("4", "no label"), ("5", "label unknown"), ("x", "no id"), ("8", "label unknown")}
    broken = [r for r in rejects.collect() if r.reason == "corrupt record"]
    assert [r.record for r in broken] == [lines[6]]
    assert c.counts == tally(rows=9, corrupt_record=1, no_id=1, no_text=1, no_label=1, label_unknown=2)


def test_csv_with_a_split_column(spark, tmp_path):
    (tmp_path / "rows.csv").write_text('id,content,stars,part\n1,"good, very",1,train\n2,bad,0,test\n3,odd,0,dev\n4,many,0,test,1,2\n5,,1,test\n6,late,9,train\n')
    c = checked_scan(spark, str(tmp_path / "rows.csv"), 2, fmt="csv", header="true", id_col="id", text_col="content", label_col="stars", split_col="part")
    rows, rejects = c.split(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "good, very", 1, "train"), (2, "bad", 0, "test")]
    assert sorted((r.raw_id, r.reason) for r in rejects.collect()) == [("3", "split unknown"), ("4", "corrupt record"), ("5", "no text"), ("6", "label unknown")]
    assert c.counts == tally(rows=6, corrupt_record=1, no_text=1, label_unknown=1, split_unknown=1)


def test_tables(spark):
    t = spark.createDataFrame([(1, "a", 1.0, 5), (None, "b", 0.0, 5), (3, "c", None, 5)], "doc_id long, content string, label double, text_len int")
    c = checked_scan(spark, t.withColumn("label", t.label.cast("int")), 2)
    assert [tuple(r)[:3] for r in c.rows.collect()] == [(1, "a", 1)]
    assert c.counts == tally(rows=3, no_id=1, no_label=1)
    empty = checked_scan(spark, t.limit(0), 2)
    assert empty.rejects.count() == 0 and empty.counts == tally(rows=0)
    with pytest.raises(ValueError, match="text"):
        checked_scan(spark, t.drop("content"), 2)


def test_user_vocabulary(spark):
    words = spark.createDataFrame([("one",), ("two words",), ("end.",), ("one",), (None,), ("",), ("Ünï_9",), ("don't",)], "token string")
    assert {r.token for r in user_vocab(words).collect()} == {"one", "Ünï_9"}
