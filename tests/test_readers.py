"""Readers and writers on small files."""

import gzip
import json

import pytest

from loomline.sources import readers as R


def _file(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_kinds(spark, tmp_path):
    rows = R.read_csv(spark, _file(tmp_path, "a.csv", "id,x\n1,NA\n2,3\n"), "id long, x long", null="NA").collect()
    assert [tuple(r) for r in rows] == [(1, None), (2, 3)]
    rows = R.read_csv(spark, _file(tmp_path, "b.tsv", "id\tx\n1\t2\nbad\tline\n3\t4\n"), "id long, x long", separator="\t", drop_bad=True).collect()
    assert [tuple(r) for r in rows] == [(1, 2), (3, 4)]
    rows = R.read_csv(spark, _file(tmp_path, "c.csv", "name\ncafé\n", "latin-1"), "name string", charset="ISO-8859-1").collect()
    assert rows[0].name == "café"
    got = R.read_preamble_csv(spark, _file(tmp_path, "d.csv", "some title\nunits: m\nid,x\n1,(D)\n2,\n3,4.5\n4,oops\n"), "id long, x double", 3, ["(D)", ""])
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, None), (2, None), (3, 4.5), (4, None)]
    assert [r.value for r in R.read_lines(spark, _file(tmp_path, "t.txt", "one\n\ntwo\n")).collect()] == ["one", "", "two"]


def test_json_kinds(spark, tmp_path):
    assert R.read_json(spark, _file(tmp_path, "a.json", '{"id": 1}\n{"id": 2}\n'), "id long").count() == 2
    rows = R.read_table_array(spark, _file(tmp_path, "b.json", json.dumps([["k", "v"], ["a", "1"], ["b", "2"]]))).collect()
    assert [(r.header, r.row) for r in rows] == [(["k", "v"], ["a", "1"]), (["k", "v"], ["b", "2"])]
    text = json.dumps({"forecast": [{"day": "mon", "hour": [{"h": 1, "t": 2.5}, {"h": 2, "t": 3.5}]}, {"day": "tue", "hour": []}]})
    got = R.nested_rows(spark.createDataFrame([("x", text)], "city string, text string"), "text", "forecast array<struct<day:string,hour:array<struct<h:int,t:double>>>>", ["forecast", "hour"])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([("x", "mon", 1, 2.5), ("x", "mon", 2, 3.5), ("x", "tue", None, None)], key=repr)
    R.write_json_dict(spark.createDataFrame([(1, "a")], "id long, name string"), str(tmp_path / "out"))
    assert [json.loads(line) for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines()] == [{"id": 1, "name": "a"}]
    value = R.csv_to_records(spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"), "rows").first().value
    assert sorted(json.loads(value)["rows"], key=lambda r: r["id"]) == [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]


def test_sentences_of_several_files_stay_apart(spark, tmp_path):
    _file(tmp_path, "s/a.txt", "1\tThe\tDT\n2\tcat\tNN\n\n1\tIt\tPRP\n")
    _file(tmp_path, "s/b.txt", "1\tA\tDT\n2\tdog\tNN\n")
    rows = R.read_sentences(spark, str(tmp_path / "s")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.sent, []).append((r.idx, r.word, r.tag))
    assert sorted(sorted(g) for g in groups.values()) == [[(1, "A", "DT"), (2, "dog", "NN")], [(1, "It", "PRP")], [(1, "The", "DT"), (2, "cat", "NN")]]


def test_vectors_folders_xml_and_html(spark, tmp_path):
    with gzip.open(tmp_path / "v.txt.gz", "wt") as f:
        f.write("cat 1 2.5\ndog 0 -1\n")
    assert {r.word: r.vector for r in R.read_vectors(spark, str(tmp_path / "v.txt.gz")).collect()} == {"cat": [1.0, 2.5], "dog": [0.0, -1.0]}
    _file(tmp_path, "c/run/dataset7.txt", "text one")
    _file(tmp_path, "c/walk/dataset12.txt", "text two")
    assert sorted((r[0], int(r[1]), r[2]) for r in R.read_class_folders(spark, str(tmp_path / "c")).collect()) == [("run", 7, "text one"), ("walk", 12, "text two")]
    xml = "<fs><inode><id>1</id><type>FILE</type><name>f</name><mtime>5</mtime><permission>u:g:0644</permission><blocks><block><numBytes>10</numBytes></block><block><numBytes>7</numBytes></block></blocks></inode><inode><id>2</id><type>DIRECTORY</type><name>d</name><mtime>6</mtime><permission>u:g:0755</permission></inode></fs>"
    got = {r.id: (r.n_blocks, r.bytes) for r in R.read_inodes(spark, _file(tmp_path, "fs.xml", xml)).collect()}
    assert got == {1: (2, 17), 2: (0, 0)}
    pages = spark.createDataFrame([(1, "<table class=x>1,5 and 2.75<td>3</table> 9"), (2, None)], "id long, html string")
    assert [r.numbers for r in R.html_numbers(pages, "html", "table").orderBy("id").collect()] == [["1", "5", "2.75", "3"], []]


def test_sqlite_and_writers(spark, tmp_path):
    path = str(tmp_path / "x.db")
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    R.replace_sqlite(df, path, "t")
    R.replace_sqlite(df, path, "t")
    assert sorted(tuple(r) for r in R.read_sqlite(spark, path, "SELECT * FROM t", "id long, name string").collect()) == [(1, "a"), (2, None)]
    R.write_csv(df.coalesce(1), str(tmp_path / "o"), "\t")
    assert "".join(p.read_text() for p in (tmp_path / "o").glob("part-*")).splitlines()[0] == "id\tname"
    sets = spark.createDataFrame([(["b"],), (["a"],), (["a", "b"],)], "items array<string>")
    assert {r.size: r.line for r in R.itemset_lines(sets).collect()} == {1: "('a'),('b')", 2: "('a', 'b')"}
    assert R.sample_rows(df, "id", 1).count() == 1 and R.sample_rows(df, "id", 5).count() == 2
