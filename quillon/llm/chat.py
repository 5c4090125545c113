"""Chat formatting by schema fingerprints.

A layout is told by the hash of its nested field paths. The fingerprint selects a declarative mapping that turns rows
of that layout into canonical turns (role, text); a template then marks the turns. For tables the paths come from the
schema; for a column of JSON texts each row is fingerprinted by the layout paths that it holds in any element, null
fields included, so layouts may differ from row to row. Where other fields make the fingerprint unknown, the layout of
most fields that is there whole is taken. Everything is DataFrame functions.

The template puts ``<|im_start|>role\\n text <|im_end|>\\n`` round each turn. Inside roles and texts ``\\`` becomes
``\\\\`` and ``<|`` becomes ``<\\|``, so no text can hold a marker, and both steps can be undone exactly; in roles a
line feed becomes ``\\n`` spelled out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How to read one layout. ``turns``: an array's path, its role and text fields, after a turn of ``lead`` (a path) by
    the system; or ``parts``: (role, path) in order, where paths joined by ``+`` are parts of one text; or ``rows``: one
    row a turn, as (order, role, text)."""

    name: str
    turns: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, str], ...] = ()
    rows: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    lead: str | None = None

    def paths(self) -> list[str]:
        if self.rows:
            return sorted(self.rows)
        if self.turns:
            return sorted([*(f"{self.turns[0]}[].{f}" for f in self.turns[1:]), *([self.lead] if self.lead else [])])
        return sorted(x for _, p in self.parts for x in p.split("+"))


SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = [
    Mapping("turn rows", rows=("turn", "role", "text")),
    Mapping("messages", turns=("messages", "role", "content"), roles=SPEAKERS),
    Mapping("conversations", turns=("conversations", "from", "value"), roles=SPEAKERS),
    Mapping("turns", turns=("turns", "speaker", "text"), roles=SPEAKERS),
    Mapping("messages system", turns=("messages", "role", "content"), roles=SPEAKERS, lead="system"),
    Mapping("conversations system", turns=("conversations", "from", "value"), roles=SPEAKERS, lead="system"),
    Mapping("turns system", turns=("turns", "speaker", "text"), roles=SPEAKERS, lead="system"),
    Mapping("instruction", parts=(("user", "instruction+input"), ("assistant", "output"))),
    Mapping("instruction only", parts=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction system", parts=(("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Mapping("instruction only system", parts=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("completion system", parts=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("question system", parts=(("system", "system"), ("user", "question"), ("assistant", "answer"))),
    Mapping("prompt", parts=(("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", parts=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt system", parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question", parts=(("user", "question"), ("assistant", "answer"))),
]
#: Every path that some layout uses; other fields of a row don't count towards its fingerprint.
VOCABULARY = sorted({p for m in MAPPINGS for p in m.paths()})


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


REGISTRY = {fingerprint(m.paths()): m for m in MAPPINGS}
#: Layouts by the number of their fields, for rows whose fingerprint is unknown.
BY_FIELDS = sorted(MAPPINGS, key=lambda m: -len(m.paths()))


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaves: ``a.b`` for fields of structs, ``a[]`` for elements of arrays."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else [at]


def mapping_of(df: DataFrame) -> Mapping:
    """The mapping of a table's layout; ValueError if no layout has these paths."""
    paths = {p for p in schema_paths(df.schema) if p in VOCABULARY}
    if (found := REGISTRY.get(fingerprint(list(paths)))) is not None:
        return found
    # other columns may have a layout's names: take the first layout, of those with most fields, that is there whole
    if (whole := next((m for m in BY_FIELDS if paths >= set(m.paths())), None)) is None:
        raise ValueError(f"no chat layout has the fields {sorted(paths)}")
    return whole


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _role(c: Column, roles: dict[str, str]) -> Column:
    named = F.lower(_text(c)) if roles else _text(c)
    out = F.when(F.lit(False), "")
    for a, b in roles.items():
        out = out.when(named == a, b)
    return out.otherwise(named)


def _led(text: Column) -> Column:
    """The system's turn before an array's, if it says something."""
    said = F.array(F.struct(F.lit("system").alias("role"), _text(text).alias("text")))
    return F.filter(said, lambda t: t["text"] != "")


def _joined(parts: list[Column]) -> Column:
    """Parts of one text, blank line between; empty parts leave no trace."""
    return F.array_join(F.filter(F.array(*map(_text, parts)), lambda x: x != ""), "\n\n")


def canonical_rows(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text): the turns of a table in any known layout, null texts and roles empty."""
    m = mapping_of(df)
    if m.rows:
        order, role, text = m.rows
        return df.select(F.col(id_col).alias("conv_id"), F.col(order).alias("turn"), _role(F.col(role), m.roles).alias("role"), _text(F.col(text)).alias("text"))
    if m.turns:
        items, role, text = m.turns
        turns = F.transform(items, lambda t: F.struct(_role(t[role], m.roles).alias("role"), _text(t[text]).alias("text")))
        turns = F.concat(_led(F.col(m.lead)), F.coalesce(turns, F.array().cast(TURNS))) if m.lead else turns
        return df.select(F.col(id_col).alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")
    turns = F.array(*(F.struct(F.lit(r).alias("role"), _joined([F.col(x) for x in p.split("+")]).alias("text")) for r, p in m.parts))
    turns = F.filter(turns, lambda t: (t["role"] != "system") | (t["text"] != ""))
    return df.select(F.col(id_col).alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")


def _content(element: Column, name: str) -> Column:
    """A text field of a JSON element; of a list of parts, the texts of those that have one, a line feed between."""
    parts = F.try_variant_get(element, f"$.{name}", "array<variant>")
    said = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string"))))
    return F.when(parts.isNotNull(), F.array_join(F.filter(said, lambda x: x.isNotNull()), "\n")).otherwise(_text(F.try_variant_get(element, f"$.{name}", "string")))


def canonical_json(df: DataFrame, json_col: str, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text, layout) of a column of JSON texts, each row in its own layout.

    Null and missing roles and texts are empty. A layout's array without elements gives one row with its layout, and
    turn, role and text null; so do, with layout null too, rows that aren't JSON objects or hold no layout whole. An
    empty table gives no rows.
    """
    v = F.col("_v")
    known = [m for m in MAPPINGS if not m.rows]
    arrays = sorted({m.turns[0] for m in known if m.turns})
    held = lambda c, path: F.try_variant_get(c, path, "variant").isNotNull()  # noqa: E731  null fields are there, too
    parsed = df.select(F.col(id_col).alias("conv_id"), F.try_parse_json(json_col).alias("_v"))
    parsed = parsed.select("*", *(F.try_variant_get(v, f"$.{a}", "array<variant>").alias(f"_{a}") for a in arrays))

    def probe(path: str) -> Column:
        array, nested, name = path.partition("[].")
        if not nested:
            return held(v, f"$.{path}")
        empty = F.size(f"_{array}") == 0
        return F.coalesce(empty | F.exists(f"_{array}", lambda e: held(e, f"$.{name}")), F.lit(False))

    vocabulary = sorted({p for m in known for p in m.paths()})
    present = F.array_compact(F.array(*(F.when(probe(p), F.lit(p)) for p in vocabulary)))
    parsed = parsed.withColumn("_present", present).withColumn("_fp", F.substring(F.sha2(F.array_join("_present", "\n"), 256), 1, 16))

    def turns_of(m: Mapping) -> Column:
        if m.turns:
            items, role, text = m.turns
            read = F.transform(f"_{items}", lambda e: F.struct(_role(F.try_variant_get(e, f"$.{role}", "string"), m.roles).alias("role"), _content(e, text).alias("text")))
            return F.concat(_led(_content(v, m.lead)), read) if m.lead else read
        spoken = [F.struct(F.lit(r).alias("role"), _joined([_content(v, x) for x in p.split("+")]).alias("text")) for r, p in m.parts]
        return F.filter(F.array(*spoken), lambda t: (t["role"] != "system") | (t["text"] != ""))

    turns, layout = F.when(F.lit(False), F.lit(None).cast(TURNS)), F.when(F.lit(False), "")
    tests = [(F.col("_fp") == fp, m) for fp, m in REGISTRY.items() if not m.rows]
    tests += [(F.size(F.array_except(F.array(*map(F.lit, m.paths())), F.col("_present"))) == 0, m) for m in BY_FIELDS if not m.rows]
    for test, m in tests:
        layout = layout.when(test, m.name)
    parsed = parsed.withColumn("layout", layout)
    for m in known:
        turns = turns.when(F.col("layout") == m.name, turns_of(m))
    out = parsed.select("conv_id", turns.alias("turns"), "layout").select("conv_id", "layout", F.posexplode_outer("turns").alias("turn", "t"))
    return out.select("conv_id", F.col("turn").cast("long"), F.col("t.role"), F.col("t.text"), "layout")


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    """Undo ``escape_role``: a spelled-out line feed follows an even number of backslashes."""
    return unescape(F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, spans): one row for each conversation.

    Turns come in the order of turn (null first), then role, then text, so ties and repeated rows have one order.
    spans has a row for each turn: start of the turn, start and end of its text in ``formatted`` (code points), and
    whether the text is under the loss mask. A null conv_id is a conversation of its own. A conversation is one
    value, so one task holds one conversation; only an empty table gives no rows.
    """
    rows = turns.select("conv_id", "turn", _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("_head", F.length("head").cast("long")).withColumn("_body", F.length("body").cast("long"))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("n", F.row_number().over(by)).withColumn("past", F.sum(F.col("_head") + F.col("_body") + len(END) + 1).over(upto))
    end = F.col("past") - len(END) - 1
    piece = F.struct("n", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), (end - F.col("_body") - F.col("_head")).alias("start"), (end - F.col("_body")).alias("content"), end.alias("end"), (F.col("role") == loss_role).alias("loss"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    spans = F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["content"].alias("content"), x["end"].alias("end"), x["loss"].alias("loss")))
    return out.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), spans.alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, losses): roles and texts parsed from ``formatted``, and the unescaped texts under the mask."""
    pieces = F.regexp_extract_all("formatted", F.lit(r"(?s)<\|im_start\|>.*?<\|im_end\|>\n"), F.lit(0))
    inner = lambda p: F.substring_index(p, END, 1)  # noqa: E731  a text can't hold the marker
    role = lambda p: unescape_role(F.replace(F.substring_index(p, "\n", 1), F.lit(START), F.lit("")))
    turns = F.transform("pieces", lambda p: F.struct(role(p).alias("role"), unescape(inner(p).substr(F.instr(p, "\n") + 1, F.length(p))).alias("text")))
    losses = F.transform(
        F.filter(F.arrays_zip("pieces", "spans"), lambda z: z["spans"]["loss"]),
        lambda z: unescape(z["pieces"].substr((z["spans"]["content"] - z["spans"]["start"] + 1).cast("int"), (z["spans"]["end"] - z["spans"]["content"]).cast("int"))),
    )
    return formatted.withColumn("pieces", pieces).select("conv_id", "formatted", turns.alias("turns"), losses.alias("losses"))


def digest(read: DataFrame) -> DataFrame:
    """Counts and digests of what ``read_back`` returns."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.col("losses"), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(whole).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
