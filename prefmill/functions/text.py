"""Text functions as Column builders. Word characters are [\\p{L}\\p{N}_], white space is the class SPACE."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, functions as F

#: Fixed values.
WORD = r"\p{L}\p{N}_"
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NULL_WORDS = ("", "nan", "null", "none")
PROMPT_LIMIT, RESPONSE_LIMIT, TOTAL_LIMIT = 96, 288, 387


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def tokens(c: Column) -> Column:
    """White-space tokens; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[{SPACE}]+"), lambda x: x != "")


def token_len(c: Column) -> Column:
    return F.size(tokens(c))


def info_len(c: Column) -> Column:
    return F.when(F.trim(c) == "no response", 0).otherwise(token_len(c))


def list_cell(c: Column) -> Column:
    """A serialized list becomes its non-blank elements, one a line; an empty list and null words become null; other
    text stays as it is. Nothing in a cell is ever evaluated."""
    parsed = F.from_json(F.regexp_replace(c, r"\\/", "/"), "array<string>")
    joined = F.array_join(F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), "\n")
    is_list = F.trim(c).rlike(r"(?s)^\[.*\]$") & parsed.isNotNull()
    return F.when(F.lower(F.trim(c)).isin(*NULL_WORDS), None).when(is_list, F.nullif(joined, F.lit(""))).otherwise(c)


#: Parts of a serialized list: a string in either quotes, three of them or one (within a line), a number or a word, and what stands between values.
_TRIPLE = r"'{3}[^'\\]*+(?:(?:\\(?s:.)|'(?!''))[^'\\]*+)*+'{3}|\"{3}[^\"\\]*+(?:(?:\\(?s:.)|\"(?!\"\"))[^\"\\]*+)*+\"{3}"
_STRING = r"'[^'\\\n\r]*+(?:\\(?s:.)[^'\\\n\r]*+)*+'|\"[^\"\\\n\r]*+(?:\\(?s:.)[^\"\\\n\r]*+)*+\""
_PLAIN = r"[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?|True|False|None"
#: Three quotes that nothing closes are a part of their own, of which no list is made.
_PART = rf"{_TRIPLE}|'{{3}}|\"{{3}}|{_STRING}|{_PLAIN}|[\[\],]"
#: What a backslash and one character stand for.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\x07", "b": "\b", "f": "\f", "v": "\x0b", "\n": "", "\\": "\\", "'": "'", '"': '"'}
#: Lists within lists, down to this depth.
DEEPEST = 5


def _unescaped(piece: Column) -> Column:
    """What a piece of a string's inside stands for: one escape, a run of \\uXXXX, or text without a backslash."""
    code = lambda skip: F.substring(piece, skip + 1, 1 << 30)
    wide = F.decode(F.unhex(F.regexp_replace(piece, r"\\u", "")), "UTF-16BE")
    points = lambda hex8: F.decode(F.unhex(F.lpad(hex8, 8, "0")), "UTF-32")
    simple = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _ESCAPES.items() for x in kv]), code(1)), piece)
    found = F.when(piece.rlike(r"^\\u"), wide).when(piece.rlike(r"^\\[xU][0-9a-fA-F]"), points(code(2))).when(piece.rlike(r"^\\[0-7]"), points(F.conv(code(1), 8, 16)))
    return F.when(~piece.startswith("\\"), piece).otherwise(found.otherwise(simple))


def _string_value(part: Column) -> Column:
    """The text of a string literal."""
    quotes = F.when(part.rlike("^('{3}|\"{3})"), 3).otherwise(1)
    inside = F.substring(part, quotes + 1, F.length(part) - 2 * quotes)
    pieces = F.regexp_extract_all(inside, F.lit(r"[^\\]++|(?:\\u[0-9a-fA-F]{4})++|\\x[0-9a-fA-F]{2}|\\U[0-9a-fA-F]{8}|\\[0-7]{1,3}|\\(?s:.)"), F.lit(0))
    return F.when(inside.contains("\\"), F.array_join(F.transform(pieces, _unescaped), "")).otherwise(inside)


def literal_cell(c: Column) -> Column:
    """A cell that holds a serialized list, with strings in single or double quotes, escapes, numbers, None, True, False
    and lists within: its non-blank values, one a line, or null if there is none. A number is its text; a list within
    is its text, in one line. A cell of one string literal is that string. \\/ becomes /; null is an empty string, and
    within a string it is quoted twice, as the format has it, so it disappears from double-quoted strings. Null words
    are null; everything else stays as it is. Parts are found and put together by expressions; nothing is evaluated."""
    return let(F.replace(F.replace(strip(c), F.lit("\\/"), F.lit("/")), F.lit("null"), F.lit('""')), lambda t: _literal(c, t))


def _literal(c: Column, t: Column) -> Column:
    is_string = lambda p: (p.startswith("'") | p.startswith('"')) & ~p.isin("'''", '"""')
    only = F.regexp_replace(t, rf"{_PART}|[{SPACE}]++", "") == ""
    kind = lambda p: F.when(is_string(p), "s").when(p.isin("[", "]", ","), p).otherwise("v")

    def shaped(parts: Column) -> Column:
        """The shape of a list: strings side by side are one value, then lists of values, from the inside."""
        shape = F.regexp_replace(F.array_join(F.transform(parts, kind), ""), "s++", "v")
        for _ in range(DEEPEST - 1):
            shape = F.regexp_replace(shape, r"(?<=[\[,])\[(?:v,)*+v?\]", "v")
        return shape.rlike(r"^\[(?:v,)*+v?\]$")

    def values(parts: Column) -> Column:
        """Values of the outer list: an empty text is begun at every comma, and parts are added to the last."""
        none = F.struct(F.lit(0).alias("deep"), F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

        def step(a: Column, p: Column) -> Column:
            deep = a["deep"] + F.when(p == "[", 1).when(p == "]", -1).otherwise(0)
            ends = ((p == ",") & (a["deep"] == 1)) | ((p == "]") & (deep == 0))
            opens = (p == "[") & (a["deep"] == 0)
            within = F.when(a["deep"] > 1, F.when(p == ",", ", ").otherwise(p)).when(is_string(p), _string_value(p)).otherwise(p)
            done = F.when(ends, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
            return F.struct(deep.alias("deep"), done.alias("done"), F.when(ends | opens, F.lit("")).otherwise(F.concat(a["now"], within)).alias("now"))

        return F.aggregate(parts, none, step, lambda a: a["done"])

    def listed(parts: Column) -> Column:
        joined = F.array_join(F.filter(F.transform(values(parts), strip), lambda x: x != ""), "\n")
        one = (F.size(parts) > 0) & F.forall(parts, is_string)
        text = F.array_join(F.transform(parts, _string_value), "")
        return F.when(shaped(parts), F.nullif(joined, F.lit(""))).when(one, text).otherwise(t)

    parts = F.regexp_extract_all(t, F.lit(_PART), F.lit(0))
    word = F.lower(strip(c)).isin(*NULL_WORDS)
    return F.when(word, None).when(t.rlike(r"^[\['\"]") & only, let(parts, listed)).otherwise(t)


def clean_text(c: Column, stopwords=(), keep_punct: bool = True) -> Column:
    """Lower case without links, mentions and tags; every character outside the kept set becomes a space, so that
    "don't" is two words; white space is collapsed; nothing left is null."""
    c = F.lower(c)
    for pattern in (rf"(https?://[^{SPACE}]+|www\.[^{SPACE}]+)", f"@[{WORD}]+", f"#[{WORD}]+"):
        c = F.regexp_replace(c, pattern, " ")
    c = F.regexp_replace(c, f"[^{WORD}{SPACE}.,!?;:]" if keep_punct else f"[^{WORD}{SPACE}]", " ")
    c = collapse(c)
    if stopwords:
        c = F.array_join(F.filter(F.split(c, " "), lambda x: ~x.isin(*stopwords)), " ")
    return F.nullif(c, F.lit(""))


def valid_utf8(c: Column) -> Column:
    return F.make_valid_utf8(c)


def normalize_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Nd}+", "<num>")


def prompt_sig(c: Column) -> Column:
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\t\r\n]+", " ")
    return normalize_digits(collapse(F.regexp_replace(c, f"[^{WORD}{SPACE}.,!?;:]", " ")))


def split_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(collapse(c), r"(?<=[.?!]) +"), lambda x: F.trim(x)), lambda x: x != "")


#: Long greeting at the beginning, disclaimer to the end of its line, sign-off at the end, list item.
GREETING = r"(?is)^\s*(hi|hello|dear|greetings)[\s.,!\-:]*.{80,300}?(?=\n|$)"
DISCLAIMER = r"(?iU)\b(as an ai|i am an ai|language model)\b[^\n]*"
SIGN_OFF = r"(?i)(best regards|kind regards|sincerely|thanks|thank you)[.,!\-:]*[^\n]*$"
BULLET = rf"^[{SPACE}]*(?:[-*•]|\p{{Nd}}+\.)[{SPACE}]+"
NO_RESPONSE = r"(?i)^(n/?a|na|none|no\s*answer|no\s*response)?$"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    """Without white space at both ends; a text that has none there is not searched."""
    end = lambda x: F.substring(x, 1, 1).rlike(f"[{SPACE}]") | F.substring(x, -1, 1).rlike(f"[{SPACE}]")
    return let(c, lambda x: F.when(end(x), F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")).otherwise(x))


#: Every match of DISCLAIMER and SIGN_OFF holds one of these, in lower case; and the letters beyond a-z that are equal to one in any case.
DISCLAIMERS = ("as an ai", "i am an ai", "language model")
SIGN_OFFS = ("best regards", "kind regards", "sincerely", "thanks", "thank you")
FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")


def _where(c: Column, words: tuple, pattern: str) -> Column:
    """c without matches of pattern, which is only tried where one of the words is."""

    def cut(x: Column) -> Column:
        return let(F.lower(F.translate(x, *FOLDED)), lambda low: F.when(functools.reduce(operator.or_, (low.contains(w) for w in words)), F.regexp_replace(x, pattern, "")).otherwise(x))

    return let(c, cut)


def strip_boilerplate(c: Column) -> Column:
    return strip(_where(_where(F.regexp_replace(c, GREETING, ""), DISCLAIMERS, DISCLAIMER), SIGN_OFFS, SIGN_OFF))


def at_most_twice(items: Column, key) -> Column:
    """(at, item) of the items whose key stands in the list twice at most up to there, or is empty, by place. Sorted by
    key, an item is one too many if the second one before it has the same key."""

    def kept(keyed: Column) -> Column:
        few = F.filter(keyed, lambda x, j: (x["key"] == "") | (j < 2) | (F.get(keyed, j - 2)["key"] != x["key"]))
        return F.array_sort(F.transform(few, lambda x: F.struct(x["at"].alias("at"), x["item"].alias("item"))))

    return let(F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("key"), i.alias("at"), x.alias("item")))), kept)


def collapse_repeats(c: Column, bullets: int = 24) -> Column:
    """The first `bullets` list items, with an ellipsis as last line if there are more; of equal blocks between blank
    lines, two at most. What separates blocks stays, also that of blocks that go."""
    gap = rf"\n[{SPACE}]*\n+"

    def items(lines: Column) -> Column:
        marked = F.transform(lines, lambda x, i: F.struct(i.alias("at"), x["item"].alias("item")))
        numbers = F.transform(F.filter(marked, lambda x: x["item"]), lambda x: x["at"])

        def kept(numbers: Column) -> Column:
            some = F.filter(lines, lambda x, i: ~x["item"] | F.coalesce(i <= F.get(numbers, F.lit(bullets - 1)), F.lit(True)))
            return F.concat(F.array_join(F.transform(some, lambda x: x["line"]), "\n"), F.when(F.size(numbers) > bullets, "\n…").otherwise(""))

        return let(numbers, kept)

    def blocks(text: Column) -> Column:
        kept = F.transform(at_most_twice(F.split(text, gap), lambda x: F.lower(strip(x))), lambda x: F.struct((2 * x["at"]).alias("at"), x["item"].alias("item")))
        gaps = F.transform(F.regexp_extract_all(text, F.lit(f"({gap})"), 1), lambda x, i: F.struct((2 * i + 1).alias("at"), x.alias("item")))
        joined = strip(F.array_join(F.transform(F.array_sort(F.concat(kept, gaps)), lambda x: x["item"]), ""))
        return let(joined, lambda out: F.when(out == "", text).otherwise(out))

    def lines(x: Column) -> Column:
        return let(let(F.transform(F.split(x, "\n"), lambda y: F.struct(y.alias("line"), y.rlike(BULLET).alias("item"))), items), blocks)

    # one line is one block, with one list item at most
    one = lambda x: let(strip(x), lambda out: F.when(out == "", x).otherwise(out))
    return lines(c) if bullets < 1 else let(c, lambda x: F.when(x.contains("\n"), lines(x)).otherwise(one(x)))


def head_tail(tok: Column, head: int, tail: int) -> Column:
    return F.when(F.size(tok) <= head + tail, tok).otherwise(F.concat(F.slice(tok, 1, head), F.array(F.lit("…")), F.slice(tok, -tail, tail)))


def sample_middle(tok: Column, target: Column | int, stride: int = 24) -> Column:
    """The first 96 tokens of the left half, every stride-th token around the middle and the last 32 of the right half,
    if there are more than target; what is still longer is clipped."""
    target = target if isinstance(target, Column) else F.lit(target)

    def picked(tok: Column) -> Column:
        n, dots = F.size(tok), F.array(F.lit("…"))
        half = F.floor(n / 2).cast("int")
        reach = F.least(F.lit(64), F.floor(n / 4).cast("int"))
        middle = F.filter(F.slice(tok, half - reach + 1, reach * 2), lambda x, i: i % max(1, stride) == 0)
        tail = F.least(F.lit(32), n - half)
        out = F.concat(F.slice(tok, 1, F.least(F.lit(96), half)), dots, middle, dots, F.slice(tok, F.least(-tail, F.lit(-1)), tail))
        return F.when(n <= target, tok).otherwise(let(out, lambda x: F.when(F.size(x) > target, F.concat(F.slice(x, 1, target - 1), dots)).otherwise(x)))

    return let(tok, picked)


def response_target(prompt_len: Column) -> Column:
    free = (TOTAL_LIMIT - F.least(prompt_len, F.lit(PROMPT_LIMIT)) - 9) / F.lit(2.0)
    return F.bround(F.greatest(F.lit(120.0), F.least(F.lit(160.0), free)), 0).cast("int")


def compress(c: Column, target: Column) -> Column:
    """Boilerplate goes; what is longer than target keeps its first 96 and last 32 tokens; what still is, its sampled
    middle, of which equal sentences stay twice at most."""

    def sampled(ends: Column) -> Column:
        middle = F.array_join(sample_middle(ends, target), " ")
        few = F.array_join(F.transform(at_most_twice(split_sentences(middle), lambda x: F.lower(x)), lambda x: x["item"]), " ")
        return let(tokens(few), lambda cut: F.array_join(F.when(F.size(cut) > target, F.concat(F.slice(cut, 1, target - 1), F.array(F.lit("…")))).otherwise(cut), " "))

    def cut(bare: Column) -> Column:
        long = lambda tok: let(head_tail(tok, 96, 32), lambda ends: F.when(F.size(ends) <= target, F.array_join(ends, " ")).otherwise(sampled(ends)))
        return F.when(bare == "", c).otherwise(let(tokens(bare), lambda tok: F.when(F.size(tok) <= target, bare).otherwise(long(tok))))

    return let(strip_boilerplate(strip(c)), cut)


def mini_prompt(c: Column) -> Column:
    return F.when(token_len(c) > PROMPT_LIMIT, F.array_join(head_tail(tokens(c), 48, 16), " ")).otherwise(c)


def sanitize(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"[\x00-\x1F\x7F-\x{9F}]", " "))


def to_text(c: Column) -> Column:
    """Serialized lists joined by lines (blank elements stay), null as empty, then sanitize()."""
    parsed = F.from_json(c, "array<string>")
    return sanitize(F.coalesce(F.when(F.trim(c).rlike(r"(?s)^\[.*\]$"), F.array_join(parsed, "\n", "None")), c, F.lit("")))


def shorten(c: Column, n: int = 160) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("...")))


def template_norm(a: Column, b: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.concat(a, F.lit(" || "), b)), "[^a-z0-9]+", " "))


def fill_no_response(c: Column) -> Column:
    c = F.trim(F.coalesce(c, F.lit("")))
    return F.when(c.rlike(NO_RESPONSE), "no response").otherwise(c)


def pct_text(c: Column) -> Column:
    return F.coalesce(F.format_string("%.2f%%", c), F.lit("0.00%"))


def round_half_even(c: Column, k: int = 2) -> Column:
    """rint(x * 10^k) / 10^k."""
    return F.rint(c * F.lit(float(10**k))) / F.lit(float(10**k))
