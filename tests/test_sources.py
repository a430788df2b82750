"""Readers, writers, audit and the streaming run."""

import csv
import zipfile

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablekit.operators.audit import Audit
from tablekit.operators.convert import FLOAT, apply_conversion
from tablekit.operators.filters import Condition as C, apply_filter
from tablekit.sources import archives, sniff
from tablekit.sources.records import line_effect
from tablekit.sources.sinks import write_csv, write_csv_like_source, write_parquet
from tablekit.sources.table import format_of, load_facts, read_table, source_facts
from tablekit.sources.text import ragged_rows
from tablekit.plans.layout import with_row_id
from tablekit.streaming.stateless import process_available

TEXT = 'id;name;price\n1;Ünal;"1.234,5"\n2;short\n3;"semi;colon";7;extra;cells\n4;;\n'
WANT = [("1", "Ünal", "1.234,5"), ("2", "short", None), ("3", "semi;colon", "7"), ("4", None, None)]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "iso-8859-1", "utf-16"])
def test_semicolon_text(spark, tmp_path, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes(TEXT.encode(encoding))
    df = read_table(spark, str(path))
    assert df.columns == ["id", "name", "price"] and rows(df) == WANT


def test_windows_1252(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("id,n€\n1,€5 – ok\n".encode("cp1252"))
    df = read_table(spark, str(path))
    assert df.columns == ["id", "n€"] and rows(df) == [("1", "€5 – ok")]


@pytest.mark.parametrize("sep, ending", [("|", "txt"), ("\t", "dat"), (",", "csv")])
def test_other_delimiters(spark, tmp_path, sep, ending):
    path = tmp_path / f"t.{ending}"
    path.write_text("\n".join(sep.join(r) for r in (["a", "b"], ["1", "x y"], ["2", "z"])))
    assert rows(read_table(spark, str(path))) == [("1", "x y"), ("2", "z")]


def _told(spark, folder, texts):
    """The dialect of each of some texts, all judged as files of one folder."""
    for i, raw in enumerate(texts):
        (folder / f"{i:02}.csv").write_bytes(raw if isinstance(raw, bytes) else raw.encode())
    found = sniff.file_dialects(sniff.survey(spark, str(folder)))
    return [found.get(f) for i in range(len(texts)) for f in [next((k for k in found if k.endswith(f"/{i:02}.csv")), None)]]


def test_guesses(spark, tmp_path):
    got = _told(spark, tmp_path, [b"plain", "é", b"caf\xe9", b"\x80 5", "x\ny".encode("utf-32"), "x\ny".encode("utf-16"), b"", "a|b\n1|2\n3|4\n"])
    assert [d and d.encoding for d in got] == ["utf-8", "utf-8", "iso-8859-1", "windows-1252", "utf-32", "utf-16", None, "utf-8"]
    assert got[-1].delimiter == "|"


def test_dialects_by_shape(spark, tmp_path):
    got = _told(spark, tmp_path, ['a;b\n"x;y,z,w";2\n"p,q";3\n', "'a','b'\n'1, 2','x'\n'3','y'\n", 'a,b\n1,"two\nlines"\n2,x\n', "one column\nonly\n",
                                  "a;b;c\n1,5;2,5;3,5\n1,5;2,5;3,5\n1;2\n", "a\tb\nit's,5\t1\ndon't\t2\n"])
    assert [(d.delimiter, d.quote, d.multiline) for d in got] == [(";", '"', False), (",", "'", False), (",", '"', True), (",", '"', False), (";", '"', False), ("\t", '"', False)]


def test_effect_of_a_line():
    effect = line_effect(",", '"')
    outside = {b"a,b": 0, b'a,"b': 1, b'"a,b"': 0, b'"a","b': 1, b'5" x,2': 0, b'a"b,"c': 1, b'"a""b': 1, b'"a""",b': 0, b'"a"",b"': 0, b'"': 1, b'""': 0, b'"a"b"c,"d': 1, b',,"': 1}
    inside = {b"x": 1, b'x",y': 0, b'x"",y': 1, b'x","y': 1, b'x"" ","y"': 0, b'"': 0, b'""': 1, b'"""': 0, b"": 1, b'end"\r': 0}
    assert [(k, effect(k, 0)) for k in outside] == [*outside.items()] and [(k, effect(k, 1)) for k in inside] == [*inside.items()]


def _table_text(seed, n, end="\n"):
    """Records with breaks, doubled quotes and delimiters in their cells, and stray quotes in plain ones."""
    import random
    rng = random.Random(seed)
    cell = lambda: rng.choice(["", "x", "plain words", '5" pipe', '"quoted"', '"a, b"', f'"two{end}lines"', f'"{end}{end}"', '"say ""hi"""', f'"""{end}"" , "', '"' + f"long {end} cell " * rng.randrange(1, 12) + '"', "'"])
    return f"id,a,b{end}" + "".join(f"{i},{cell()},{cell()}{end}" for i in range(n))


@pytest.mark.parametrize("split", ["64", "300", "2000", "1000000"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_across_splits(spark, tmp_path, split, end):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_bytes(_table_text(k, 120, end).encode())
    (tmp_path / "open.csv").write_text('id,a,b\n1,x,"never closed\nmore\n\nlast')
    want = rows(spark.read.csv(str(tmp_path), header=True, escape='"', multiLine=True))
    conf = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = read_table(spark, str(tmp_path), format="text")
        cells = [tuple(x and x.replace("\r\n", "\n") for x in r) for r in df.collect()]  # Spark's own reader makes them line feeds
        assert sorted(cells, key=str) == sorted(want, key=str)
        if split == "300":
            numbered = read_table(spark, str(tmp_path), format="text", row_id=True).orderBy("_row_id").collect()
            assert [r["_row_id"] for r in numbered] == list(range(len(want)))
            assert [r["id"] for r in numbered] == [str(i) for _ in range(3) for i in range(120)] + ["1"]
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_files_of_several_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,note\n1,é one\n2,\"x;y\"\n")
    (tmp_path / "b.csv").write_bytes("id;note\n3;€ three\n4;Köln, four\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes("note|id|more\nfünf|5|x\n".encode("latin-1"))
    (tmp_path / "d.csv").write_bytes("id\tnote\r\n6\t\"six\r\nlines\"\r\n".encode("utf-16"))
    (tmp_path / "e.csv").write_text('id,note\n7,"seven\nlines"\n')
    df = read_table(spark, str(tmp_path), format="text")
    want = [("1", "é one", None), ("2", "x;y", None), ("3", "€ three", None), ("4", "Köln, four", None), ("5", "fünf", "x"), ("6", "six\nlines", None), ("7", "seven\nlines", None)]
    assert df.columns == ["id", "note", "more"] and rows(df) == want
    numbered = read_table(spark, str(tmp_path), format="text", row_id=True).orderBy("_row_id").collect()
    assert [r["id"] for r in numbered] == [w[0] for w in want]
    assert [r["id"] for r in read_table(spark, str(tmp_path), format="text", n_rows=3, row_id=True).orderBy("_row_id").collect()] == ["1", "2", "3"]
    facts = {r["file"][-5:]: r for r in load_facts(spark, str(tmp_path), "text").collect()}
    assert [(facts[k]["encoding"], facts[k]["delimiter"], facts[k]["line_breaks"], facts[k]["rows"], facts[k]["columns"]) for k in sorted(facts)] == [
        ("utf-8", ",", False, 2, 3), ("windows-1252", ";", False, 2, 3), ("iso-8859-1", "|", False, 1, 3), ("utf-16", "\t", True, 1, 3), ("utf-8", ",", True, 1, 3)]
    assert all(abs(r["size_mb"] * 1048576 - (tmp_path / k).stat().st_size) < 0.1 for k, r in facts.items())


def test_ragged_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,2,3\n1,2\n\n1,"2,2",3,4\n1\n')
    (tmp_path / "b.csv").write_text('a;b\n"x\n;y";2\n"p";3;4\n')
    (tmp_path / "c.csv").write_text("a|b\n1|2\n")
    got = sorted((r["file"][-5:], r["rows"], r["short_rows"], r["long_rows"]) for r in ragged_rows(spark, str(tmp_path)).collect())
    assert got == [("a.csv", 4, 2, 1), ("b.csv", 2, 0, 1), ("c.csv", 1, 0, 0)]
    with pytest.raises(ValueError, match="a.csv: 2 short, 1 long"):
        read_table(spark, str(tmp_path), format="text", on_ragged="raise")
    assert read_table(spark, str(tmp_path / "c.csv"), on_ragged="raise").count() == 1


def test_numbers_and_caps_in_file_order(spark, tmp_path):
    path = str(tmp_path / "p")
    for k, name in enumerate("cab"):
        spark.range(k * 1000, k * 1000 + 50 + 100 * k, 1, 1).write.parquet(f"{path}/{name}.parquet")
    files = [*range(1000, 1150), *range(2000, 2250), *range(50)]
    one = str(tmp_path / "p" / "*")
    got = read_table(spark, one, format="parquet", row_id=True)
    assert [r["id"] for r in got.orderBy("_row_id").collect()] == files
    assert "Checkpoint" not in got.select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["id"] for r in read_table(spark, one, format="parquet", n_rows=170).collect()) == sorted(files[:170])
    kept = with_row_id(spark.read.parquet(one).where("id % 2 = 0"))
    assert [r["id"] for r in kept.orderBy("_row_id").collect()] == [i for i in files if i % 2 == 0] and kept.agg(F.max("_row_id")).first()[0] == sum(i % 2 == 0 for i in files) - 1
    with pytest.raises(ValueError, match="order_by"):
        with_row_id(spark.range(9).groupBy(F.col("id") % 3).count())


def test_empty_table_keeps_its_header(spark, tmp_path):
    write_csv_like_source(spark.createDataFrame([], "a string, b int"), str(tmp_path / "e"), sep=";")
    df = read_table(spark, str(tmp_path / "e"), format="text")
    assert df.columns == ["a", "b"] and df.count() == 0


def test_text_that_is_utf8_only_at_first(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b\n" + b"plain,row\n" * 120_000 + "x,München\n".encode("cp1252"))
    assert read_table(spark, str(tmp_path / "a.csv")).where("a = 'x'").first()["b"] == "München"
    (tmp_path / "b.csv").write_bytes(b"a,b\n" + b"plain,row\n" * 120_000 + "x,München\n".encode())
    assert read_table(spark, str(tmp_path / "b.csv")).where("a = 'x'").first()["b"] == "München"


def test_line_breaks_survive(spark, tmp_path):
    df = spark.createDataFrame([("1", "a\nb"), ("2", 'c "d"\n')], "k string, t string")
    write_csv_like_source(df, str(tmp_path / "m"))
    assert rows(read_table(spark, str(tmp_path / "m"), format="text")) == rows(df)


def test_line_breaks_beyond_the_sample(spark, tmp_path):
    late = tmp_path / "late.csv"
    plain = [(str(i), "x" * 80) for i in range(2**20 // 80)]
    late.write_text("id,note\n" + "".join(f"{a},{b}\n" for a, b in plain) + '"z","two\nlines"\n')
    assert rows(read_table(spark, str(late))) == sorted([*plain, ("z", "two\nlines")])
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text("id,note\n1,one\n")
    (folder / "b.csv").write_text('id,note\n2,"two\nlines"\n')
    assert rows(read_table(spark, str(folder), format="text")) == [("1", "one"), ("2", "two\nlines")]
    (tmp_path / "w.csv").write_bytes("id,note\n".encode() + "".join(f"{a},{b}\n" for a, b in plain).encode() + '"z","é\né"\n'.encode("cp1252"))
    assert rows(read_table(spark, str(tmp_path / "w.csv"))) == sorted([*plain, ("z", "é\né")])


def test_json_parquet_and_options(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"a": 1, "b": {"c": "x"}}, {"a": 2, "b": {"c": "y"}}]')
    (tmp_path / "t.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert rows(read_table(spark, str(tmp_path / "t.json")).select("a", "b.c")) == [(1, "x"), (2, "y")]
    assert read_table(spark, str(tmp_path / "t.jsonl"), strings=True).dtypes == [("a", "string")]
    spark.range(100, numPartitions=3).withColumn("_row_id", F.lit(0)).transform(lambda d: write_parquet(d, str(tmp_path / "p")) or d)
    df = read_table(spark, str(tmp_path / "p"), format="parquet", columns=["id"], n_rows=7)
    assert df.columns == ["id"] and df.count() == 7
    facts = source_facts(spark.read.parquet(str(tmp_path / "p"))).first()
    assert (facts["rows"], facts["columns"], facts["files"]) == (100, 1, 3) and facts["size_mb"] > 0
    assert read_table(spark, str(tmp_path / "t.jsonl"), row_id=True).columns == ["a", "_row_id"]
    with pytest.raises(ValueError):
        format_of("x.pdf")


def test_csv_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', 2.5, 0), (None, None, None, 1)], "n int, t string, f double, _row_id int").coalesce(1)
    write_csv_like_source(df, str(tmp_path / "a"), sep=";", quote="'")
    text = next((tmp_path / "a").glob("part-*")).read_text()
    assert text == "'n';'t';'f'\n1;'say \"hi\"';2.5\n;;\n"
    write_csv(df, str(tmp_path / "b"))
    with open(next((tmp_path / "b").glob("part-*")), newline="") as f:
        assert list(csv.reader(f)) == [["n", "t", "f"], ["1", 'say "hi"', "2.5"], ["", "", ""]]


def workbook(path, sheets):
    """Minimal workbook; ints are numeric cells, text alternates between shared and inline strings."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shared = []
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns} {rel}><sheets>" + "".join(
            f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(
            f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, table in enumerate(sheets.values()):
            body = ""
            for r, cells in enumerate(table, 1):
                body += f'<row r="{r}">'
                for c, v in enumerate(cells):
                    at = f"{chr(65 + c)}{r}"
                    if v is None:
                        continue
                    if isinstance(v, bool):
                        body += f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
                    elif isinstance(v, int):
                        body += f'<c r="{at}"><v>{v}</v></c>'
                    elif c % 2:
                        body += f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
                    else:
                        shared.append(v)
                        body += f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'
                body += "</row>"
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"First": [["id", "name"], [1, "x"], [2, None]], "Second": [["k", "flag"], ["q", True]]})
    workbook(tmp_path / "b.xlsx", {"First": [["id", "name"], [3, "z"]], "Second": [["k", "flag"], ["p", False]]})
    assert rows(archives.list_sheets(spark, str(tmp_path / "*.xlsx")), "position", "sheet") == [(0, "First"), (0, "First"), (1, "Second"), (1, "Second")]
    assert rows(read_table(spark, str(tmp_path / "*.xlsx"))) == [("1", "x"), ("2", None), ("3", "z")]
    assert rows(read_table(spark, str(tmp_path / "a.xlsx"), sheet="Second")) == [("q", "true")]
    assert rows(read_table(spark, str(tmp_path / "a.xlsx"), sheet="Missing")) == [("1", "x"), ("2", None)]


def test_numpy_archives(spark, tmp_path):
    np.savez(tmp_path / "a.npz", grid=np.arange(6).reshape(3, 2), line=np.array([0.5, 1.5]),
             rec=np.array([(1, "a"), (2, "b")], dtype=[("n", "i4"), ("s", "U2")]), cube=np.zeros((2, 2, 2)))
    np.savez(tmp_path / "only.npz", x=np.array([1, 2, 3]))
    path = str(tmp_path / "a.npz")
    assert rows(archives.list_arrays(spark, path), "array", "shape") == [("cube", [2, 2, 2]), ("grid", [3, 2]), ("line", [2]), ("rec", [2])]
    assert rows(read_table(spark, path, array="grid")) == [(0, 1), (2, 3), (4, 5)]
    assert read_table(spark, path, array="grid").columns == ["col_0", "col_1"]
    assert rows(read_table(spark, path, array="line")) == [(0.5,), (1.5,)]
    assert rows(read_table(spark, path, array="rec")) == [(1, "a"), (2, "b")]
    assert rows(read_table(spark, str(tmp_path / "only.npz"))) == [(1,), (2,), (3,)]
    for array in (None, "cube", "nope"):
        with pytest.raises(ValueError):
            read_table(spark, path, array=array)


def test_audit(spark, tmp_path):
    audit = Audit("demo")
    raw = audit.load(spark.range(100), "memory")
    kept = audit.step(raw, raw.where("id < 30"), "Filter", "id < 30", {"value": 30})
    assert kept.count() == 30
    audit.saved(kept, "nowhere")
    audit.append_to(spark, str(tmp_path / "log"))
    got = [(r["category"], r["rows_before"], r["rows_after"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()]
    assert got == [("load", None, 100), ("Filter", 100, 30), ("save", 30, 30)]


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(50).selectExpr("id", "concat('€', id, ',5') as price").repartition(3).write.parquet(str(source))

    def clean(df):
        priced = apply_conversion(df, "price", FLOAT)
        return apply_filter(priced, [C("price", ">", "20", field_type="Numeric")]).withColumn("twice", F.col("price") * 2)

    batch = spark.read.parquet(str(source))
    stream = spark.readStream.schema(batch.schema).parquet(str(source))
    process_available(stream, clean, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(clean(batch))
    with pytest.raises(ValueError):
        process_available(batch, clean, "x", "y")


def test_files_in_key_order_are_written_by_ranges(spark, tmp_path):
    """The file-order query leaves no table to one task, also where a key comes often or is null."""
    from tablekit.queries import QUERIES

    keys = [None, None] + [7] * 500 + list(range(1000, 0, -1))
    spark.createDataFrame([(k,) for k in range(3)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = QUERIES["row_id_in_file_order"](spark, str(tmp_path))
        got = [tuple(r) for r in out.select("_row_id", "k").orderBy("_row_id").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len([f for f in out.inputFiles() if "name=b" in f]) > 1
    assert got == list(enumerate([0, 1, 2, None, None] + sorted(keys[2:])))
