"""Text functions: normal forms, lengths, identifiers copied from a source, trigram similarity."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from skeinwork.functions.scoring import CHARS_PER_TOKEN, MEDIA_TOKENS

#: What separates words: Unicode white space and the four ASCII information separators.
_SPACE = "(?U)[\\s\\x{1c}-\\x{1f}]+"

# What counts as an identifier that must be copied unaltered.
IDENTIFIERS = (
    r"(?<![A-Za-z0-9_])tool_[A-Za-z0-9]+(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9])[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9-])(?=[0-9a-f]{7,64}(?![A-Za-z0-9-]))(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{7,64}(?![A-Za-z0-9-])",
    r"(?<![A-Za-z0-9_])#[0-9]+(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)+(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+){2,}(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])/[A-Za-z0-9._~!$&'()*+=:@%/-]+(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9]*(?:-[A-Z][A-Za-z0-9]*)+(?![A-Za-z0-9_])",
)


def collapse(text: Column) -> Column:
    """Words joined by one blank."""
    return F.regexp_replace(F.regexp_replace(text, "^" + _SPACE + "|" + _SPACE + "$", ""), _SPACE, " ")


def normalize_name(text: Column) -> Column:
    """Case-folded, white space collapsed, by built-in expressions: full case folding of all Latin, Greek and Cyrillic letters.

    Letters whose folding is longer than themselves other than the sharp s are left as lower case makes them; where those can
    occur and the result is hashed, use `normalize_name_exact`.
    """
    folded = F.translate(F.lower(F.replace(F.replace(text, F.lit("ẞ"), F.lit("ss")), F.lit("İ"), F.lit("i̇"))), "ςſµ", "σsμ")
    return collapse(F.replace(folded, F.lit("ß"), F.lit("ss")))


@F.pandas_udf(StringType())
def normalize_name_exact(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else " ".join(t.casefold().split()))


# Where words of a predicate in code style meet, after an acronym and at a hump.
_AFTER_ACRONYM, _HUMP = "([A-Z]{3,})([A-Z][a-z]{2,})", "(?<=[a-z])(?=[A-Z])"


def normalize_predicate(predicate: Column) -> Column:
    """A predicate in code style as natural words."""
    spaced = F.regexp_replace(F.replace(predicate, F.lit("_"), F.lit(" ")), _AFTER_ACRONYM, "$1 $2")
    return collapse(F.lower(F.regexp_replace(spaced, _HUMP, " ")))


def natural_predicate(predicate: Column) -> Column:
    """Whether a predicate is natural language: not empty, no underscore, no capital after a small letter."""
    return (F.length(F.trim(predicate)).between(1, 500)) & ~predicate.contains("_") & ~predicate.rlike("[a-z][A-Z]")


def utf8_length(text: Column) -> Column:
    return F.octet_length(text)


def utf16_length(text: Column) -> Column:
    """Code units of UTF-16: code points, and one more for each outside the basic plane."""
    return F.length(text) + F.length(F.regexp_replace(text, "[\\x{0}-\\x{ffff}]", ""))


def identifiers(text: Column) -> Column:
    """The distinct identifiers in a text."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in IDENTIFIERS]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def unsupported(output: Column, source: Column) -> Column:
    """Identifiers of an output text that its source has neither in one piece nor, if dotted, part by part."""
    def part(p: Column) -> Column:
        return F.rlike(source, F.concat(F.lit("(?<![A-Za-z0-9_])"), p, F.lit("(?![A-Za-z0-9_])")))

    missing = F.array_except(identifiers(output), identifiers(source))
    return F.filter(missing, lambda t: ~(t.contains(".") & F.forall(F.split(t, "\\."), part)))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words (runs of letters and digits) of a text, each padded by two blanks before and one after."""
    ws = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    grams = F.flatten(F.transform(ws, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_distinct(grams)


def similarity(a: Column, b: Column) -> Column:
    """Share of common trigrams of two trigram sets; 0 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0)), F.lit(0.0))


@F.pandas_udf(StringType())
def first_json(text: pd.Series) -> pd.Series:
    """The first JSON value of a text as compact JSON, whatever follows it; null if it does not begin with one."""
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.JSONDecoder().raw_decode(t.lstrip())[0], separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


# What stands for content that is left out, and how deep a value may be nested.
NESTED_MARK, DATA_URL_MARK, CLEARED_MARK, DEEPEST = "[nested value omitted]", "[data URL omitted]", "[Old tool result content cleared]", 8


def trimmed_value(root: object) -> object:
    """A copy of a JSON value in which what is nested too deeply and texts that are data URLs are replaced by their marks.

    Works through an explicit list of places still to fill, so that no depth of input can exhaust the stack.
    """
    top: list = [root]
    open_: list[tuple[list | dict, object, int]] = [(top, 0, 0)]
    while open_:
        holder, at, depth = open_.pop()
        value = holder[at]
        if depth > DEEPEST:
            holder[at] = NESTED_MARK
        elif isinstance(value, str):
            if value.startswith("data:"):
                holder[at] = DATA_URL_MARK
        elif isinstance(value, (list, dict)):
            holder[at] = fresh = value.copy()
            open_ += [(fresh, k, depth + 1) for k in (fresh if isinstance(fresh, dict) else range(len(fresh)))]
    return top[0]


def compact_json(value: object) -> str:
    """JSON without blanks, whole numbers without a fraction."""
    def whole(x: object) -> object:
        if isinstance(x, float) and x.is_integer() and abs(x) < 1e21:
            return int(x)
        return [whole(v) for v in x] if isinstance(x, list) else {k: whole(v) for k, v in x.items()} if isinstance(x, dict) else x

    return json.dumps(whole(value), separators=(",", ":"), ensure_ascii=False)


def _parsed(t: str | None) -> object:
    try:
        return None if t is None else json.loads(t)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def sanitized_json(text: pd.Series) -> pd.Series:
    """JSON without data URLs and without what lies deeper than eight levels; null where it is no JSON."""
    return text.map(lambda t: None if t is None or (v := _parsed(t)) is None else compact_json(trimmed_value(v)))


def _compacted(state: object) -> bool:
    time = state.get("time") if isinstance(state, dict) else None
    stamp = time.get("compacted") if isinstance(time, dict) else None
    return isinstance(stamp, (int, float)) and not isinstance(stamp, bool)


def shown_state(state: object) -> object:
    """A tool's state as a model sees it: the output of a compacted one is cleared, then values are trimmed."""
    return trimmed_value({**state, "output": CLEARED_MARK} if _compacted(state) else state)


@F.pandas_udf(StringType())
def tool_state_json(state: pd.Series) -> pd.Series:
    """The state (JSON) of a tool part as a model sees it; `null` where there is none or it is no JSON."""
    return state.map(lambda t: compact_json(shown_state(_parsed(t))))


def data_url_bytes(url: Column) -> Column:
    """Size of a data URL's content in bytes: of base64 three for four characters, rounded up, else its UTF-8 length. Null for other URLs."""
    comma = F.locate(",", url)
    head, payload = F.substring(url, F.lit(1), comma - 1), F.substring(url, comma + 1, F.length(url))
    size = F.when(head.endswith(";base64"), F.ceil(utf16_length(payload) * 3 / 4)).otherwise(F.octet_length(payload))
    return F.when(url.startswith("data:") & (comma > 0), size.cast("long"))


def media_tokens(mime: Column, url: Column) -> Column:
    """What a file weighs in tokens: an image a fixed number, a data URL a token for two bytes but no less than an image; else infinitely many."""
    size = data_url_bytes(url)
    other = F.when(size.isNotNull(), F.greatest(F.lit(float(MEDIA_TOKENS)), F.ceil(size / 2).cast("double"))).otherwise(float("inf"))
    return F.when(F.coalesce(mime, F.lit("")).startswith("image/"), float(MEDIA_TOKENS)).otherwise(other)


def media_tokens_of(part: object) -> float:
    """The same of a JSON object with mime and url."""
    if not isinstance(part, dict):
        return float("inf")
    if str(part.get("mime") if isinstance(part.get("mime"), str) else "").startswith("image/"):
        return float(MEDIA_TOKENS)
    url = part.get("url")
    if not isinstance(url, str) or not url.startswith("data:") or "," not in url:
        return float("inf")
    head, payload = url.split(",", 1)
    units = len(payload) + sum(c > "\uffff" for c in payload)
    size = -(-units * 3 // 4) if head.endswith(";base64") else len(payload.encode())
    return float(max(MEDIA_TOKENS, -(-size // 2)))


def attachment_tokens_of(value: object) -> float:
    """Media tokens of the attachments of a completed tool's state that was not compacted; 0 for any other."""
    if isinstance(value, dict) and value.get("status") == "completed" and not _compacted(value) and isinstance(value.get("attachments"), list):
        return float(sum(media_tokens_of(a) for a in value["attachments"]))
    return 0.0


def tool_weight_of(state: str | None) -> float:
    """UTF-16 units of a tool's shown state as JSON, and four for each token of its attachments."""
    value = _parsed(state)
    shown = compact_json(shown_state(value))
    return len(shown) + sum(c > "\uffff" for c in shown) + CHARS_PER_TOKEN * attachment_tokens_of(value)


@F.pandas_udf(StructType([StructField("bytes", LongType()), StructField("media", DoubleType())]))
def tool_measures(state: pd.Series) -> pd.DataFrame:
    """UTF-8 bytes of a tool's shown state as JSON, and the tokens of its attachments."""
    values = [_parsed(t) for t in state]
    return pd.DataFrame({"bytes": [len(compact_json(shown_state(v)).encode()) for v in values], "media": [attachment_tokens_of(v) for v in values]})


# How much of a tool's output and of its attachments a record keeps.
OUTPUT_MOST, ATTACHMENTS_MOST = 2_000, 10


def tool_record_of(tool: str | None, state: str | None) -> tuple[str | None, bool, str | None]:
    """(entry, whether something was cut, why something is missing) of an archived tool part."""
    value = _parsed(state)
    status = value.get("status") if isinstance(value, dict) else None
    if tool is None or status not in ("completed", "error"):
        return None, False, None if tool is None else "unfinished-tools"
    given = compact_json(value.get("input"))
    if status == "error":
        told = str(value.get("error") or "unknown error")
        return f"[Tool {tool} error] {given}\n{told[:OUTPUT_MOST]}", len(told) > OUTPUT_MOST, None
    cleared, said = _compacted(value), value.get("output")
    body = "[output was compacted]" if cleared else said[:OUTPUT_MOST] if isinstance(said, str) else ""
    files = value.get("attachments") if isinstance(value.get("attachments"), list) else []
    named = [(f["filename"][:500] if isinstance(f.get("filename"), str) else "unnamed attachment") + (f" ({f['mime'][:200]})" if isinstance(f.get("mime"), str) else "") for f in files[:ATTACHMENTS_MOST] if isinstance(f, dict)]
    entry = f"[Tool {tool}] {given}\n{body or '[no text output]'}" + (f"\nAttachments: {', '.join(named)}" if named else "")
    return entry, (not cleared and isinstance(said, str) and len(said) > OUTPUT_MOST) or len(files) > ATTACHMENTS_MOST, "archived-media" if files else None


@F.pandas_udf(StructType([StructField("entry", StringType()), StructField("cut", BooleanType()), StructField("missing", StringType())]))
def tool_record(tool: pd.Series, state: pd.Series) -> pd.DataFrame:
    rows = [tool_record_of(t, s) for t, s in zip(tool, state, strict=True)]
    return pd.DataFrame(rows, columns=["entry", "cut", "missing"]) if rows else pd.DataFrame({"entry": [], "cut": [], "missing": []})


@F.pandas_udf(DoubleType())
def tool_state_weight(state: pd.Series) -> pd.Series:
    return state.map(tool_weight_of).astype(float)


def typed_json(text: Column, kind: str) -> Column:
    """A JSON text if its value is of a kind (`array`, `object`, `string`, `number`, `boolean`), else null."""
    value = F.try_parse_json(text)
    shape = F.lower(F.schema_of_variant(value))
    of = {"array": shape.startswith("array"), "object": shape.startswith("object"), "string": shape == "string", "boolean": shape == "boolean"}
    return F.when(of.get(kind, shape.rlike("^(bigint|decimal|double|float|int)")), text)


def redacted(text: Column, secret: Column, most: int = 500) -> Column:
    """A message for the log: the secret replaced, white space collapsed, cut to size."""
    return F.left(collapse(F.when(secret != "", F.replace(text, secret, F.lit("[REDACTED]"))).otherwise(text)), F.lit(most))


def iso_time(at: Column) -> Column:
    """A time as ISO 8601 text in UTC with milliseconds."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
