"""Text extraction and cleaning of raw model answers (T1-T6, P5), all as Catalyst expressions.

Patterns are written so that Java regex (Spark) and RE2 read them the same way:
Python's notion of whitespace is spelled out as a character class instead of
relying on ``\\s`` (ASCII in RE2, different again in Java).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelab.functions.scale import _col, let

# Python's Unicode whitespace (str.isspace / str.strip) as a character class body.
WS_CHARS = r"\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WS_CHARS}]"
NONBLANK = f"[^{WS_CHARS}]"
# The same characters as a literal set for trim().
WS_LITERAL = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# Python str.splitlines() boundaries.
SPLITLINES = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"

# The ordered rewrites of the answer cleaner.
FENCE = f"(?m)^```[a-zA-Z]*{WS}*|{WS}*```$"
LEAD_WRAPPER = f'\\A\\{{{WS}*"(?:code|completion)"{WS}*:{WS}*"'
TRAIL_WRAPPER = f'"{WS}*\\}}{WS}*\\z'
ANGLE_TOKEN = r"<[^>]*>"
SPECIAL_TOKEN = r"<\|[^>]*\|>"
ZERO_WIDTH = r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]"
TRAILING_BLANKS = r"[ \t]+\n"
MANY_NEWLINES = r"\n{3,}"


def _java(p: str) -> str:
    """Java needs (?d) so that ^/$ under (?m) treat only \\n as a line end, as Python does."""
    return p.replace("(?m)", "(?md)")


def py_strip(s) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.trim(_col(s), F.lit(WS_LITERAL))


def clean_code(s, special_tokens_only: bool = False) -> Column:
    """The nine ordered rewrites (fences, strip, JSON wrapper, special tokens,
    U+2581/U+FF5C, zero-width, trailing blanks, blank runs, strip)."""
    x = _col(s)
    x = F.regexp_replace(x, _java(FENCE), "")
    x = py_strip(x)
    x = F.regexp_replace(x, LEAD_WRAPPER, "")
    x = F.regexp_replace(x, TRAIL_WRAPPER, "")
    x = F.regexp_replace(x, SPECIAL_TOKEN if special_tokens_only else ANGLE_TOKEN, "")
    x = F.translate(x, "▁｜", " |")
    x = F.regexp_replace(x, ZERO_WIDTH, "")
    x = F.regexp_replace(x, TRAILING_BLANKS, "\n")
    x = F.regexp_replace(x, MANY_NEWLINES, "\n\n")
    return py_strip(x)


def split_lines(s) -> Column:
    """Python ``str.splitlines()`` boundaries (a trailing empty piece may remain; it is blank)."""
    return F.split(_col(s), SPLITLINES, -1)


def logical_lines(s) -> Column:
    """P5: number of lines that are not blank after strip."""
    return F.size(F.filter(split_lines(s), lambda line: F.regexp_like(line, F.lit(NONBLANK))))


def first_json_span(s) -> Column:
    """Text of the first balanced ``{...}`` (every brace counts, also inside strings);
    NULL when there is no ``{`` or it never closes.

    Linear in the text: the tail from the first brace is split after every brace and
    a fold tracks depth and consumed length; the span is one ``substring`` at the end.
    """
    x = _col(s)
    start = F.instr(x, "{")
    tail = F.substring(x, start, F.length(x))
    pieces = F.split(tail, r"(?<=[{}])", -1)
    init = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("len"), F.lit(False).alias("done"))

    def step(st, p):
        last = F.substring(p, -1, 1)
        d = st["depth"] + F.when(last == "{", 1).when(last == "}", -1).otherwise(0)
        return F.when(st["done"], st).otherwise(
            F.struct(d.alias("depth"), (st["len"] + F.length(p)).alias("len"),
                     ((d == 0) & (last == "}")).alias("done"))
        )

    return let(F.aggregate(pieces, init, step),
               lambda st: F.when((start > 0) & st["done"], F.substring(tail, 1, st["len"])))


def code_field(v) -> Column:
    """The ``code`` string of a parsed object, else ``completion`` when ``code`` is
    missing or JSON null; NULL unless the chosen value is a JSON string."""
    v = _col(v)

    def pick(code, comp):
        code_missing = code.isNull() | (F.schema_of_variant(code) == F.lit("VOID"))
        chosen = F.when(code_missing, comp).otherwise(code)
        return F.when(F.schema_of_variant(chosen) == F.lit("STRING"), F.variant_get(chosen, "$", "string"))

    return let(F.struct(F.try_variant_get(v, "$.code", "variant").alias("c"),
                        F.try_variant_get(v, "$.completion", "variant").alias("p")),
               lambda st: pick(st["c"], st["p"]))


def extract_code(raw) -> Column:
    """Code string of the first JSON object in the answer, or NULL."""
    return code_field(F.try_parse_json(first_json_span(raw)))


def extract_lenient(raw) -> Column:
    """T4: cleaned code from the JSON object, else the cleaned raw answer."""
    r = _col(raw)
    return F.coalesce(clean_code(extract_code(r)), clean_code(r))


def extract_strict(raw) -> Column:
    """T5: struct(code, error): code is the cleaned JSON code field; error says why not."""
    r = _col(raw)

    def build(st):
        span, parsed = st["span"], st["parsed"]
        err = (
            F.when(r.isNull() | (F.instr(r, "{") == 0), F.lit("no_object"))
            .when(span.isNull(), F.lit("unclosed"))
            .when(parsed.isNull(), F.lit("invalid_json"))
        )

        def finish(code):
            e = F.coalesce(err, F.when(code.isNull(), F.lit("no_code_field")))
            return F.struct(F.when(e.isNull(), clean_code(code)).alias("code"), e.alias("error"))

        return let(code_field(parsed), finish)

    spanned = let(first_json_span(r), lambda span: F.struct(span.alias("span"),
                                                             F.try_parse_json(span).alias("parsed")))
    return let(spanned, build)
