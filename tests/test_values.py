import pytest
from pyspark.sql import functions as F

from quillon.functions import text, values

GOOD = {
    "bool": {"true": True, "TRUE": True, "yes": True, "No": False, "1": True, "0": False},
    "i64": {"-0": 0, "+5": 5, "-17": -17, "007": 7, "9223372036854775807": 2**63 - 1, "-9223372036854775808": -(2**63)},
    "f64": {"1.5": 1.5, "-2.25": -2.25, "1e10": 1e10, "1E-3": 1e-3, ".5": 0.5, "5.": 5.0, "-.5": -0.5, "9223372036854775808": 9223372036854775808.0, "1e400": float("inf")},
    "date": {"1970-01-01": 0, "1969-12-31": -1, "2024-02-29": 19782, "0000-01-01": -719528, "9999-12-31": 2932896},
    "datetime": {"1970-01-01T00:00": 0, "1970-01-01 00:00:00.123456789": 123456, "1970-01-01T05:30+05:30": 0, "1969-12-31T16:00:00-0800": 0, "1970-01-02T00:00:01.5Z": 86_401_500_000},
}
BAD = {
    "bool": ["2", "01", "t", "y", "", " true", "truе"],
    "i64": ["9223372036854775808", "1,234", "1_000", "1.0", "1e3", "+", " 1", "1 ", "0x10", "1\n", "٣"],
    "f64": [".", "e5", "1e", "1e+", "inf", "NaN", "infinity", "0x1p3", "1,5", "1.2.3", " 1.0", "1d", "1f"],
    "date": ["2026-02-30", "1900-02-29", "2026-13-01", "2026-1-01", "2026/01/01", "2026", "2026-01-01T00:00"],
    "datetime": ["1970-01-01", "1970-01-01T24:00", "1970-01-01T23:59:60", "1970-01-01T00", "1970-01-01T00:00:00.", "1970-01-01T00:00.5", "1970-01-01T00:00+05", "1970-01-01T00:00+5:30", "1970-01-01T00:00+24:00", "1970-01-01T00:00 Z", "1970-01-01T00:00z", "1970-02-30T00:00"],
}
PARSE = {"bool": values.parse_bool, "i64": values.parse_i64, "f64": values.parse_f64, "date": values.parse_date, "datetime": values.parse_datetime}


@pytest.mark.parametrize("label", GOOD)
def test_recognisers(spark, label):
    cases = [*GOOD[label].items(), *((s, None) for s in BAD[label])]
    assert [(s, PARSE[label](s)) for s, _ in cases] == cases
    v = values.recognise(F.col("s"), label)
    v = F.unix_date(v) if label == "date" else F.unix_micros(v) if label == "datetime" else v
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string").select("i", v.alias("v"))
    assert [r.v for r in df.orderBy("i").collect()] == [w for _, w in cases]


def test_formats(spark):
    for us, s in ((0, "1970-01-01T00:00:00Z"), (1_500_000, "1970-01-01T00:00:01.5Z"), (-1, "1969-12-31T23:59:59.999999Z")):
        assert values.spell_datetime(us) == s
        assert spark.range(1).select(values.format_datetime(F.timestamp_micros(F.lit(us)))).first()[0] == s
    for days in (-719528, -1, 0, 19782, 2932896):
        assert values.parse_date(values.spell_date(days)) == days
    assert values.is_leap_year(2000) and not values.is_leap_year(1900) and values.days_in_month(2024, 2) == 29


def test_text_helpers(spark):
    assert text.parse_size("64K") == 65536 and text.parse_size("1.5GiB") == 3 << 29 and text.parse_size("7") == text.parse_size("7 b") == 7
    assert text.parse_count("0") == 0 and text.parse_count("2.5M") == 2_500_000 and text.parse_count(".5k") == 500
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 4300: "4.2 KB", 1536: "1.5 KB", 1048524: "1023.9 KB", 1048575: "1.0 MB", 1 << 40: "1.0 TB", 1 << 62: "4096.0 PB"}
    assert {n: text.format_size(n) for n in sizes} == sizes
    counts = {999: "999", 1000: "1k", 1_250: "1.2k", 20_000: "20k", 12_345_678: "12.3M", 412_900_000: "412M", 1_500_000_000: "1.5G", 2 * 10**12: "2T"}
    assert {n: text.format_count_compact(n) for n in counts} == counts and text.format_count(1234567) == "1,234,567"
    etas = {None: "—", 0: "~1 s left", 23: "~23 s left", 59.6: "~1 min left", 240: "~4 min left", 3600: "~1 h left", 4320: "~1 h 12 min left"}
    assert {s: text.format_eta(s) for s in etas} == etas and text.format_rate(2048, 1) == "2.0 KB/s" and text.format_rate(1, 0) == "0 B/s"
    assert text.width("漢字a") == 5 and text.width("e\u0301" * 3) == 3 and text.width("🦀") == text.width("👨\u200d👩\u200d👧") == text.width("🇩🇪") == 2
    assert text.truncate_end("abcdef", 4) == "abc…" and text.truncate_end("日本語", 4) == "日…" and text.truncate_end("abc", 0) == ""
    assert text.truncate_middle("abcdef", 5) == "ab…ef" and text.truncate_middle("abcdef", 4) == "ab…f" and text.truncate_middle("日本語", 3) == "…語"
    assert [text.fit("ab", 4), text.fit("ab", 4, right=True), text.fit("日本語", 4), text.fit("a🦀b", 3), text.fit("日", 1), text.fit("x", 0)] == ["ab  ", "  ab", "日 …", "a …", "…", ""]
    assert text.fit("e\u0301" * 3, 2) == "e\u0301…" and text.prefix_within("👨\u200d👩\u200d👧x", 1) == "" and text.display_segments("") == [("", False)]
    assert text.display_segments("\u200fx") == [("\u200fx", False)]
    assert text.display_segments("a\tb‮") == [("a", False), ("\\t", True), ("b", False), ("\\u{202e}", True)]
    assert text.levenshtein("price", "prcie") == 2
    df = spark.createDataFrame([("漢字",), ("abc",), (None,)], "s string")
    assert [r[0] for r in df.select(text.display_width("s")).collect()] == [4, 3, None]
    for bad in ("", "x", "1Q"):
        with pytest.raises(ValueError):
            text.parse_size(bad)
