import csv
import io
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quillon.operators import commands, export, profile, sampling, search
from quillon.operators.jobs import Jobs
from quillon.operators.saved import SavedView, SavedViews
from quillon.operators.views import POS, SortError, View, ViewStack, open_view, parse_sort
from quillon.sources.source import ROW, Source
from quillon.streaming.watch import Watcher

ROWS = [(0, "b", "3", "x"), (1, "A", "NA", "y"), (2, "a", "10", "x"), (3, None, "3", "x"), (4, "b", "bad", "q,\"z"), (5, "b", "3", "x")]


@pytest.fixture(scope="module")
def source(spark):
    return Source.from_dataframe(spark.createDataFrame(ROWS, "id long, name string, n string, t string"), "id").set_type("n", "i64")


def ids(view):
    return [r[ROW] for r in view.rows().collect()]


def test_sorts(source):
    v = View.all(source)
    assert ids(v.sort("n")) == [0, 3, 5, 2, 1, 4] and ids(v.sort("n:desc")) == [2, 0, 3, 5, 1, 4]
    assert ids(v.sort("name:ci, n:desc")) == [2, 1, 0, 5, 4, 3] and ids(v.sort("name:desc")) == [0, 4, 5, 2, 1, 3]
    assert ids(v.sort("name").sort("t")) == [4, 0, 2, 3, 5, 1]
    assert v.sort("n:desc, t").indicator() == {"n": "▼1", "t": "▲2"}
    for bad, span in (("zz", (0, 2)), ("n:up", (0, 4)), ("t, n:ci", (3, 7)), ("n,,t", (2, 2))):
        with pytest.raises(SortError) as e:
            parse_sort(bad, source)
        assert e.value.span == span


def test_composition(source):
    s = v = View.all(source).sort("n:desc")
    assert ids(v.filter('t == "x"')) == [2, 0, 3, 5] and v.filter('t == "x"').parent is s
    assert ids(v.dupes("name")) == [0, 5, 4] and ids(v.dedupe("name")) == [2, 0, 3, 1] and ids(View.all(source).dedupe("name")) == [0, 1, 2, 3]
    assert ids(View.all(source).dupes("name, n, t")) == [0, 5]
    assert View.all(source).dupes_summary("name").first().asDict() == {"groups": 1, "rows": 6, "removed": 2}
    assert v.position_of(5) == 3 and v.row_at(3) == 5 and v.filter("n > 5").position_of(0) is None
    assert View.all(source).filter("n == 3").position_of(5) == 2
    assert [r[POS] for r in v.positions().orderBy(POS).collect()] == list(range(6))
    assert [r[ROW] for r in v.window(1, 2).collect()] == [0, 3] and [r and r[ROW] for r in v.fetch([5, 99, 0])] == [5, None, 0]
    assert v.goto("50%") == 2 and v.goto("1_000") == 5 and v.goto("2") == 1
    stack = ViewStack(source)
    stack.filter("n == 3")
    assert [x.label for x in stack.views] == ["all rows", "filtered"] and stack.pop().label == "all rows" and stack.pop() is stack.views[0]


def test_dupes_of_whole_rows(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("a,b\nx,\nx\nx,,\nNULL,1\n,1\nNULL,1\n")
    s = Source.open(spark, str(path))
    assert ids(View.all(s).dupes()) == [0, 1, 3, 5] and ids(View.all(s).dedupe()) == [0, 2, 3, 4]


def test_frozen_rows(source):
    stack = ViewStack(source)
    stack.filter('name == "b"')
    stack.rebase(source.edit("name", "upper"))
    assert ids(stack.active) == [0, 4, 5]
    assert {r["name"] for r in stack.active.select().collect()} == {"B"}
    assert ids(stack.filter('name == "B"')) == [0, 4, 5]


def test_profile(spark, source):
    [n] = profile.profile(source, ["n"], full=False)
    assert (n.rows_seen, n.nulls, n.non_null, n.distinct, n.min, n.max, n.mean) == (6, 1, 5, 3, 3, 10, 4.75)
    assert (n.p50, round(n.p95, 6), n.max_width, n.top5, n.other) == (3.0, 8.95, 3, [("3", 3), ("10", 1), ("bad", 1)], 0)
    assert n.label == "sample 6 rows"
    names = [s.column for s in profile.profile(source)]
    assert names == ["id", "name", "n", "t"]
    long = Source.from_dataframe(spark.createDataFrame([("é" * 200,)], "v string"))
    [(v, k)] = profile.profile(long)[0].top5
    assert v.endswith("…") and len(v.encode()) <= 256 + 3 and k == 1
    assert profile.width_p95(source, source.df, source.column("t")) == 4
    big = Source.from_dataframe(spark.range(20_000).select(F.col("id").cast("string").alias("v")))
    [p] = profile.profile(big.set_type("v", "i64"))
    assert abs(p.distinct - 20_000) < 800 and abs(p.p50 - 10_000) < 400 and p.mean == 9999.5


def test_sampling(spark):
    assert sampling.spread_ids(25, 10, 5) == [10, 13, 16, 19, 22] and sampling.spread_ids(10, 10, 5) == []
    for rows in (5, 12, 25, 1000, 1003):
        got = [r[0] for r in spark.range(rows).where(sampling.in_sample(F.col("id"), rows, 10, 7)).orderBy("id").collect()]
        assert got == [*range(min(rows, 10)), *sampling.spread_ids(rows, 10, 7)], rows


def test_search(source):
    s = search.parse_search("b", source)
    assert (s.text, s.regex, s.column) == ("b", False, None)
    assert search.parse_search("name: re:^b", source).column.query == "name" and search.parse_search("zz: b", source).text == "zz: b"
    assert search.find_in_cell("banana", search.parse_search("re:an", source)) == [(1, 3), (3, 5)]
    v = View.all(source)
    cells = [(r[ROW], r.column) for r in search.hits(v, s).orderBy(ROW, "slot").collect()]
    assert cells == [(0, "name"), (4, "name"), (4, "n"), (5, "name")]
    keys = [(0, 1), (4, 1), (4, 2), (5, 1)]
    for pos in range(6):
        for slot in range(4):
            want = min((k for k in keys if k > (pos, slot)), default=keys[0])
            hit = search.next_match(v, s, pos, slot)
            assert (hit.pos, hit.slot, hit.wrapped) == (*want, want <= (pos, slot))
            if pos % 3 == 0:
                want = max((k for k in keys if k < (pos, slot)), default=keys[-1])
                assert (lambda h: (h.pos, h.slot))(search.next_match(v, s, pos, slot, backwards=True)) == want
    assert search.next_match(v.sort("n:desc"), s, 0, 0).row_id == 0
    assert search.next_match(v, search.Search("nothing"), 0, 0) is None


def test_export(spark, tmp_path, source):
    v = View.all(source.set_type("n", "auto")).sort("name:desc")
    target = str(tmp_path / "out.csv")
    assert export.export(v, target) == 6
    with open(target, newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == ["id", "name", "n", "t"] and rows[1:3] == [["0", "b", "3", "x"], ["4", "b", "bad", 'q,"z']] and rows[-1][1] == ""
    assert not os.path.exists(target + ".partial")
    export.export(v, target, every=True, header=False, delimiter=";")
    assert open(target).readline() == '"0";"b";"3";"x"\n'
    one = Source.from_dataframe(spark.createDataFrame([("",), ("x",), (None,)], "v string"))
    assert [r[0] for r in export.lines(View.all(one)).collect()] == ['""', "x", '""']
    back = Source.open(spark, target, infer=False)
    with pytest.raises(export.ExportError):
        export.export(View.all(back), target)
    os.symlink(target, tmp_path / "link.csv")
    for bad in (str(tmp_path / "link.csv"), str(tmp_path), str(tmp_path / "no" / "x.csv")):
        with pytest.raises(export.ExportError):
            export.export(View.all(back), bad)
    assert export.default_target(View.all(back).sort("col1")) == "out.sorted.csv" and export.default_target(v) == "stdin.sorted.csv"
    assert export.copy_cell(v, 4, "t") == 'q,"z' and export.copy_row(v, 4) == '4,b,bad,"q,""z"'
    export.export_parts(v, str(tmp_path / "parts"))
    assert spark.read.text(str(tmp_path / "parts")).count() == 6


def test_export_round_trip(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, "".join(r.choice('ab,"\n\r é') for _ in range(r.randint(0, 6))), "".join(r.choice("xy ") for _ in range(3))) for i in range(80)]
    source = Source.from_dataframe(spark.createDataFrame(rows, "id long, a string, b string"), "id")
    target = str(tmp_path / "r.csv")
    export.export(View.all(source), target)
    with open(target, newline="") as f:
        assert [x[1:] for x in csv.reader(io.StringIO(f.read(), newline=""))][1:] == [list(x[1:]) for x in rows]


def test_open_view(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text("id,price\n1,5\n2,50\n3,7\n")
    stack = open_view(spark, str(path), filter="price > 6", sort="price:desc")
    assert [r["f0"] for r in stack.active.rows().collect()] == ["2", "3"] and len(stack.views) == 3


def test_saved_views(tmp_path):
    path = str(tmp_path / "views.json")
    saved = SavedViews(path, [SavedView("fixed", "a == 1")])
    saved.save(SavedView("cheap", "price < 5", "*.csv"))
    again = SavedViews(path)
    assert [v.name for v in again.all("x.csv")] == ["cheap"] and again.all("x.tsv") == [] and [v.name for v in saved.all()] == ["fixed", "cheap"]
    assert again.delete("cheap") and not again.delete("cheap")
    open(path, "w").write("{broken")
    assert SavedViews(path).all() == [] and os.path.exists(path + ".corrupt")
    with pytest.raises(ValueError):
        saved.save(SavedView(" ", "x"))


def test_commands(spark, source, tmp_path):
    assert commands.parse("set type n i64") == commands.Invocation("set type", "n i64") and commands.parse("view: cheap") == commands.Invocation("view", "cheap")
    with pytest.raises(commands.CommandError):
        commands.parse("bogus x")
    saved = SavedViews(str(tmp_path / "v.json"))
    saved.save(SavedView("three", "n == 3"))
    bench = commands.Workbench(spark, ViewStack(source), saved)
    assert ids(bench.run("filter n >= 3")) == [0, 2, 3, 5] and ids(bench.run("sort n:desc")) == [2, 0, 3, 5]
    assert ids(bench.run("dedupe n")) == [2, 0] and bench.run("goto 2") == 1 and bench.run("goto name").query == "name"
    bench.stack.pop()
    bench.run("edit name: upper")
    assert {r["name"] for r in bench.stack.active.select().collect()} == {"A", "B", None}
    bench.run("reset edits")
    bench.run("set type n str")
    assert bench.source.column("n").label == "str"
    assert ids(bench.run("view: three")) == [0, 3, 5]
    assert bench.run(f"export {tmp_path}/o.csv") == 3 and [p.column for p in bench.run("profile n")] == ["n"]
    bench.run("freeze 2")
    bench.run("delete view three")
    assert bench.display["freeze"] == 2 and saved.all() == []


def test_jobs(spark):
    jobs = Jobs(spark)
    job = jobs.submit("profile", lambda: spark.range(10).count())
    assert job.done.wait(60) and (job.state, job.result) == ("done", 10)
    failed = jobs.submit("sort", lambda: 1 / 0)
    assert failed.done.wait(60) and failed.state == "failed"
    gate = []
    slow = jobs.submit("export", lambda: [time.sleep(0.05) for _ in iter(lambda: bool(gate), True)])
    with pytest.raises(RuntimeError):
        jobs.submit("export", lambda: 1)
    other = jobs.submit("export", lambda: spark.range(1000).repartition(4).count(), tab=2)  # another tab's
    assert other.done.wait(60) and other.result == 1000
    done, tasks = jobs.progress(other)
    assert 0 < done <= tasks and jobs.progress(failed) == (0, 0)
    jobs.cancel(slow)
    first = jobs.submit("filter", lambda: [time.sleep(0.05) for _ in iter(lambda: len(gate) > 1, True)], parent="all")
    beside = jobs.submit("filter", lambda: 1, parent="another")
    assert beside.done.wait(60) and first.state in ("queued", "running")
    jobs.submit("filter", lambda: 2, parent="all")
    assert first.state == "cancelled"
    gate += [1, 2]
    assert slow.done.wait(60) and slow.state == "cancelled" and first.done.wait(60)


def test_watch(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("a")
    w = Watcher(str(path), every=2)
    assert w.poll(w.at + 1) is None and w.poll(w.at + 3) is None
    path.write_text("ab")
    assert w.poll(w.at + 3) == "changed" and w.poll(w.at + 3) is None
    path.unlink()
    assert w.poll(w.at + 3) == "deleted"


def test_sort_helpers(source):
    v = View.all(source)
    assert ids(v.sort_by("n", True)) == ids(v.sort("n:desc"))
    assert v.sort_cost(1 << 20) == {"rows": 6, "run_bytes": 144, "result_bytes": 48, "in_memory": True} and not v.sort_cost(100)["in_memory"]


def test_generated_file_and_command_line(spark, tmp_path, capsys):
    from quillon.__main__ import main
    from quillon.sources import generate

    generate.write(spark, str(tmp_path / "g"), 300, nulls=0.1, ragged=0.05, quoted_newlines=0.2)
    path = str(tmp_path / "g.csv")
    with open(path, "w", newline="") as out:
        for part in sorted(p for p in os.listdir(tmp_path / "g") if p.startswith("part-")):
            out.write(open(tmp_path / "g" / part, newline="").read())
    s = Source.open(spark, path)
    assert [c.display for c in s.columns] == list(generate.HEADER) and s.scan.strategy == "blocks"
    counts = s.counts()
    assert counts["rows"] == 300 and 0 < counts["ragged"] < 40
    assert [s.column(c).label for c in ("id", "price", "date", "ts", "country", "status")] == ["i64", "f64", "date", "datetime", "enum", "enum"]
    main([path, "--filter", "price > 0 && country == \"DE\"", "--sort", "price:desc", "--rows", "5"], spark)
    shown = list(csv.reader(io.StringIO(capsys.readouterr().out)))
    prices = [float(r[1]) for r in shown[1:]]
    assert shown[0] == list(generate.HEADER) and prices == sorted(prices, reverse=True) and {r[4] for r in shown[1:]} == {"DE"}
    main([path, "-d", "comma", "--dedupe", "country", "--export", str(tmp_path / "o.csv")], spark)
    assert capsys.readouterr().out == "11 records\n"
    main([path, "--profile"], spark)
    assert "price" in capsys.readouterr().out
