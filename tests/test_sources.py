import glob
import io
import random

import pytest

from quillon.functions.edits import EditError, parse_ops
from quillon.operators import profile as profiles
from quillon.operators.sampling import SampleResult
from quillon.operators.views import View
from quillon.sources import dialect as D
from quillon.sources import generate, records
from quillon.sources.source import ROW, Source, SourceError, raw_lines, spool
from quillon.streaming.watch import Watcher

#: file content: what differs from a plain comma file with a header
SNIFF = {
    "id,name,price\n1,a,2.5\n2,b,3\n": {},
    "id\tcity\n1\tx\n2\ty\n": {"delimiter": "\t"},
    "code|label\nA|1\nB|2\n": {"delimiter": "|"},
    "nom;prix\na;1,5\nb;2,5\nc;3,0\n": {"delimiter": ";"},
    "user:uid\nroot:0\nx:1\n": {"delimiter": ":"},
    "x y\n1 2\n3 4\n": {"delimiter": " "},
    "alpha\nbeta\ngamma\n": {},
    "1,2,3\n4,5,6\n": {"header": False},
    'id,address\n1,"a, b"\n2,"c, d"\n': {"quote": '"'},
    'id,q\n1,"a ""b"" c"\n': {"quote": '"'},
    'id,q\n1,"a \\"b\\" c"\n': {"quote": '"', "escape": "backslash"},
    "id,name\n1,'a, b'\n2,'c'\n": {"quote": "'"},
    "id,name\r\n1,a\r\n": {"line_ending": "crlf"},
    "id,name\r\n1,a\n": {"line_ending": "mixed"},
}


@pytest.mark.parametrize("content", SNIFF)
def test_sniff(content):
    want = {"delimiter": ",", "quote": None, "escape": "doubled", "line_ending": "lf", "header": True, "encoding": "utf-8", "comment": None} | SNIFF[content]
    assert vars(D.sniff(content.encode()).dialect) == want


def test_sniff_more():
    assert D.sniff('a,b\n1,"x\ny"\n2,z\n'.encode()).quoted_newlines
    assert D.sniff(b"\xef\xbb\xbfid,x\n1,2\n").dialect.encoding == "utf-8-bom"
    assert D.sniff("id,x\n1,é\n".encode("cp1252")).dialect.encoding == "windows-1252"
    for e in ("utf-16le", "utf-16be"):
        mark = b"\xff\xfe" if e == "utf-16le" else b"\xfe\xff"
        assert D.sniff(mark + "id;x\n1;2\n2;3\n".encode(D.CODECS[e])).dialect == D.Dialect(";", None, "doubled", "lf", True, e)
    report = D.sniff(b"a;b,c\n1;2,3\n", overrides=D.Overrides(delimiter=";", header=False))
    assert report.dialect.delimiter == ";" and not report.dialect.header and report.detected.delimiter == ","
    long = b"a,b\n" + b"1,2\n" * 50_000
    assert D.sniff(long, 1000).sample_len < 1010 and not D.sniff(long, 1000).sample_truncated
    assert D.sniff(b'a,"' + b"x" * (3 << 20), 1000).sample_truncated


def test_records_match_the_csv_module():
    import csv

    r = random.Random(3)
    for _ in range(300):
        rows = [["".join(r.choice('ab,"\n é') for _ in range(r.randint(0, 5))) for _ in range(r.randint(2, 4))] for _ in range(r.randint(1, 6))]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(rows)
        assert [x.fields for x in records.records(out.getvalue(), D.Dialect())] == rows


@pytest.fixture(scope="module")
def blocks(spark):
    """Sessions share a context: small blocks for this module only."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("seed", range(10))
def test_reader_follows_the_record_rules(blocks, tmp_path, seed):
    r = random.Random(seed)
    q = r.choice(['"', "'", None])
    escape = r.choice(["doubled", "backslash"]) if q else "doubled"
    alphabet = list("ab1, \ré") + ([q, q, "\\"] if q else []) + (["\n"] if r.random() < 0.6 else [])
    plain = [c for c in alphabet if c not in "\n,"]
    text = ""
    for _ in range(r.randint(1, 60)):
        fields = [q + "".join(r.choice(alphabet) for _ in range(r.randint(0, 6))) + q + r.choice(["", "x"]) if q and r.random() < 0.4 else "".join(r.choice(plain) for _ in range(r.randint(0, 5))) for _ in range(r.randint(1, 4))]
        text += ",".join(fields) + r.choice(["\n", "\n", "\r\n", "\n\n", "\n#c\n"])
    path = tmp_path / "f.csv"
    path.write_text(text, newline="")
    over = D.Overrides(delimiter=",", quote=q, escape=escape, header=False, encoding="utf-8", comment="#")
    want = [x.fields for x in records.records(text, D.Dialect(",", q, escape, "lf", False, "utf-8", "#"))]
    source = Source.open(blocks, str(path), over, infer=False)
    got = source.df.orderBy(ROW).collect()
    assert [x[ROW] for x in got] == list(range(len(want)))
    assert [[x[f"f{i}"] for i in range(x["_n_fields"])] for x in got] == want
    assert source.scan.rows == len(want)


def test_open(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,name,price,name\n1,a,1.5,x\n2,b\n3,NULL,2.5,y,extra\n\n4,d,bad,z\n")
    s = Source.open(spark, str(path))
    assert [c.query for c in s.columns] == ["id", "name", "price", "name_2", "_extra1"] and s.columns[4].synthetic
    assert s.counts() == {"rows": 4, "ragged": 2, "unterminated": False}
    assert s.column("id").label == "i64" and s.set_type("price", "f64").column("price").label == "f64"
    got = s.df.orderBy(ROW).collect()
    assert got[1]["f2"] is None and got[2]["f4"] == "extra"
    native = Source.open(spark, str(path), strict=False)
    assert native.df.count() == 4
    assert [r.line for r in raw_lines(spark, str(path)).collect()][4] == ""


def test_encodings(spark, tmp_path):
    text = "id,name\n1,café\n2,“x”\n"
    for encoding, mark in (("utf-8", b""), ("utf-8", b"\xef\xbb\xbf"), ("cp1252", b""), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")):
        path = tmp_path / f"{encoding}{len(mark)}.csv"
        path.write_bytes(mark + text.encode(encoding))
        s = Source.open(spark, str(path))
        assert [c.display for c in s.columns] == ["id", "name"], encoding
        assert [r[0] for r in s.df.orderBy(ROW).select("f1").collect()] == ["café", "“x”"], encoding


def test_odd_files(spark, tmp_path):
    for name, text, rows in (("empty", "", 0), ("header", "a,b\n", 0), ("one", "a\n1\n2\n", 2), ("open", 'a,b\n1,"x\ny\n', 1), ("tail", "a,b\n1,2", 1)):
        path = tmp_path / name
        path.write_text(text)
        s = Source.open(spark, str(path))
        assert s.df.count() == rows, name
        assert s.counts()["unterminated"] == (name == "open")
    with pytest.raises(SourceError) as e:
        Source.open(spark, str(tmp_path / "none"))
    assert e.value.kind == "NotFound"
    with pytest.raises(SourceError) as e:
        Source.open(spark, str(tmp_path))
    assert e.value.kind == "IsDirectory"
    assert open(spool(io.BytesIO(b"a,b\n"), str(tmp_path)), "rb").read() == b"a,b\n"


EDITS = [
    ("drop 1", "hello", "ello"), ("chop 2", "hello", "hel"), ("chop 0", "hello", ""), ("take 2", "hello", "he"), ("slice 1:3", "hello", "el"), ("slice -3:", "hello", "llo"), ("slice :-1", "hello", "hell"), ("slice 3:1", "hello", ""),
    ("take 1", "👨‍👩‍👧x", "👨‍👩‍👧"), ("drop 1", "éa", "a"), ("trim", "  x  ", "x"), ("ltrim", "  x ", "x "), ("rtrim", " x  ", " x"), ("trim xy", "xyaxy", "a"),
    ("upper", "straße", "STRASSE"), ("lower", "ÀB", "àb"), ("title", "o'neil x-RAY 3d 'tis élan_vital", "O'neil X-Ray 3d 'tis Élan_Vital"), ("lpad 5 0", "42", "00042"), ("lpad 2", "12345", "12345"), ("rpad 4 .", "ab", "ab.."),
    ("prefix <", "a", "<a"), ('suffix " !"', "a", "a !"), ("replace a bb", "banana", "bbbnbbnbb"), ("s/a/X/", "banana", "bXnana"), ("s/a/X/g", "banana", "bXnXnX"), ("s/(b)(a)/$2$1/", "banana", "abnana"), ("s#A#y#gi", "banana", "bynyny"),
    ("s/(?P<w>n)a/${w}0/g", "banana", "ban0n0"), ("s/^b|a$/_/g", "banana", "_anan_"), ("s/$/!/", "ab", "ab!"), ("s/a/$$1/", "a", "$1"), ("trim | upper | take 2", " abc ", "AB"),
]


def test_edits(spark, tmp_path):
    for text, value, want in EDITS:
        ops = parse_ops(text)
        assert [str(o) for o in parse_ops(" | ".join(map(str, ops)))] == [str(o) for o in ops]
        s = Source.from_dataframe(spark.createDataFrame([(value,), (None,), ("NA",)], "v string")).edit("v", text)
        got = [r[0] for r in s.df.select(s.text(s.columns[0])).collect()]
        assert got == [want, None, "NA"], text
    (tmp_path / "e.csv").write_text("v,w\na1,x\nb2,y\n")
    s = Source.open(spark, str(tmp_path / "e.csv")).edit("v", "drop 1")
    assert s.column("v").label == "i64" and s.edit("v", "undo").edits == {} and s.edit("v", "upper").reset_edits().edits == {}
    assert s.df.where(s.filter("v == 2").column).count() == 1


@pytest.mark.parametrize(
    ("text", "message", "span"),
    [("", "nothing to do: name an edit, such as drop 1", (0, 0)), ("drop", "drop takes a count", (4, 4)), ("drop x", "drop takes a count, and x is none", (5, 6)), ("bogus", "there is no edit bogus", (0, 5)), ("slice 1", "slice takes a range such as 2:5, 1: or :-1, and 1 is none", (6, 7)), ("lpad 3 ab", "lpad fills with one character", (7, 9)), ('replace "" x', "replace needs something to look for", (8, 10)), ("s/a/b", "this substitution stops short of s/pattern/text/", (0, 5)), ("s/a/b/x", "a substitution has the flags g and i, not x", (6, 7)), ("upper lower", "lower comes where | or the end belongs", (6, 11)), ("upper |", "no edit follows the |", (7, 7)), ('prefix "x', "this text has no closing quote", (7, 9))],
)
def test_edit_errors(text, message, span):
    with pytest.raises(EditError) as e:
        parse_ops(text)
    assert e.value.message.startswith(message) and e.value.span == span


def test_encodings_of_whole_files(spark, tmp_path):
    """Files of every encoding read alike; a UTF-16 file's copy lies in the folder that executors share."""
    want = None
    for encoding in generate.MARKS:
        path = str(tmp_path / f"{encoding}.csv")
        generate.write_file(spark, path, 50, encoding, quoted_newlines=0.3, nulls=0.1)
        s = Source.open(spark, path)
        assert s.report.dialect.encoding == (encoding if encoding != "windows-1252" else s.report.dialect.encoding)
        got = sorted(tuple(r) for r in s.df.collect())
        want = want or got
        assert got == want and len(got) == 50
    copies = glob.glob(spark.conf.get("spark.checkpoint.dir") + "/quillon-utf16-*")
    assert copies


def test_many_files(spark, tmp_path):
    """Rows of several Parquet files have rising, unique, contiguous ids, and duplicates go by them."""
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(i % 3, i) for i in range(10)], "k int, v int").repartitionByRange(2, "v").sortWithinPartitions("v").write.parquet(path)
    s = Source.parquet(spark, path)
    assert sorted((r[ROW], r.v) for r in s.df.collect()) == [(i, i) for i in range(10)]
    view = View.all(s)
    assert sorted(r.v for r in view.dedupe("k").df.collect()) == [0, 1, 2]
    assert sorted(r.v for r in view.sort("v:desc").dedupe("k").df.collect()) == [7, 8, 9]
    assert [r.v for r in view.fetch([7, 2])] == [7, 2] and view.sort("v:desc").position_of(3) == 6
    assert sorted((r["_pos"], r.v) for r in view.sort("v:desc").numbered("v").collect()) == [(i, 9 - i) for i in range(10)]
    assert [r.v for r in view.filter("v > 6").matches()] == [7, 8, 9]
    kept = Source.from_dataframe(spark.read.parquet(path))
    assert View.all(kept).dedupe("k").df.count() == 3


def test_sample_result(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("a,b\n" + "".join(f"x{i % 7},{i}\n" for i in range(200)))
    r = SampleResult.of(Source.open(spark, str(path)))
    path.write_text("gone")  # the sample is kept: nothing reads the file again
    (stats,) = r.stats("b")
    assert (stats.type, stats.rows_seen, stats.max) == ("i64", 200, 199)
    typed = r.set_type("b", "str")
    assert typed.stats("b")[0].max is None and profiles.stale(stats, typed.source) and not profiles.stale(stats, r.source)
    assert r.edit("a", "drop 1").source.column("a").label == "i64" and r.edit("a", "drop 1").stats("a")[0].max == 6


def test_watch_reopens(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("a\n1\n")
    s, w = Source.open(spark, str(path)), Watcher(str(path), every=0)
    path.write_text("a,b\n1,2\n3,4\n")
    assert w.poll() == "changed"
    again = w.reload(spark, s)
    assert again.counts()["rows"] == 2 and [c.display for c in again.columns] == ["a", "b"]
