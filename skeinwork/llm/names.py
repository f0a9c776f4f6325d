"""Variant spellings of names linked to the entity they name: a symmetric-delete index on tokens, then optimal alignment.

1. Every entity name (canonical or alias) becomes tokens. Its distinctive tokens - those fewest entities share - go into an
   index under themselves and under all their single-letter deletions.
2. Every distinct mention text is cut into tokens (at blanks, punctuation, and case changes of glued names); each token, and
   for handles the token without its leading initial, is looked up by the same deletions. A hit within one edit
   (insertion, deletion, replacement, transposition) of a distinctive token makes the entity a candidate.
3. Tokens of text and name are aligned by optimal assignment. Equal tokens cost nothing; lost accents, nicknames, initials,
   abbreviations and edits cost a little; what is left over on either side costs by its kind.
4. The entity of least cost is the answer if that cost is within `limit` and no other entity is as cheap.

Nicknames are learned from the entities' own aliases, and which tokens are common from their frequency; no list of names or
trades is used. Mentions are looked up once per distinct text, so a text that a third of all mentions share is aligned once.
All steps are joins and aggregations; the index is broadcast only if its exact number of rows is small.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.session import BROADCAST_BYTES
from skeinwork.session import cut as checkpointed

LIMIT = 0.7
#: Bytes of a row of the index or of a name's token in memory, at most.
ROW_BYTES = 200
#: Tokens that say nothing about which entity is meant.
LEGAL = frozenset("gmbh ag inc ltd llc bv sa nv plc co corp kg se oy ab as srl spa limited incorporated corporation gesellschaft mbh aktiengesellschaft besloten vennootschap naamloze societe anonyme sociedad anonima sociedade company".split())
TITLES = frozenset("dr mr mrs ms mx miss prof professor sir herr frau mme m. the our team people folks from by of".split())
#: A token that at most so many entities share is distinctive, even if another of the name is rarer.
RARE = 3


def fold(token: str) -> str:
    """A token without accents, in lower case."""
    if token.isascii():
        return token.casefold()
    base = "".join(c for c in unicodedata.normalize("NFKD", token) if not unicodedata.combining(c)).casefold()
    return base.translate(str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ı": "i"}))


def cut(text: str) -> list[tuple[str, bool]]:
    """(token in lower case with its accents, whether a full stop marks it as short) of a name."""
    text = unicodedata.normalize("NFC", text)
    text = re.sub(r"\b(\w)\.(?=\w\.)", r"\1", text)
    words: list[tuple[str, bool]] = []
    for m in re.finditer(r"[^\W_]+(?:['’][^\W\d_]+)?(\.(?=\s|,|$))?", text):
        raw, dot = m[0].rstrip("."), bool(m[1])
        glued = re.findall(r"[^\W\d_a-zà-öø-ÿ]?[a-zà-öø-ÿ]+|[^\W_]+", raw) if re.search(r"[a-zà-öø-ÿ]{2}[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]", raw) else [raw]
        words += [(w.casefold(), dot and i == len(glued) - 1) for i, w in enumerate(glued)]
    return words


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two tokens, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def deletions(token: str) -> list[str]:
    """A folded token and all forms of it with one letter left out; tokens of under four letters stand for themselves alone."""
    return list({token, *(token[:i] + token[i + 1 :] for i in range(len(token)))}) if len(token) >= 4 else [token]


def _fit(word: str, short: bool, token: str, forms: frozenset[str]) -> float | None:
    """Cost of taking a word of the text for a token of the name; None if it cannot be."""
    if word == token:
        return 0.0
    w, t = fold(word), fold(token)
    if w == t:
        return 0.04
    if w in forms:
        return 0.1
    if len(w) == 1:
        return 0.2 if t[0] == w else None
    if short and 2 <= len(w) < len(t) and t.startswith(w):
        return 0.15
    if min(len(w), len(t)) >= (3 if w[0] == t[0] else 4) and (d := distance(w, t, 1)) <= 1:
        return 0.3 * d
    return None


def align(words: list[tuple[str, bool]], name: list[str], forms: list[frozenset[str]], rare: list[bool], limit: float = LIMIT) -> float | None:
    """Least cost of aligning a text with a name; None if no distinctive token is met in full. Costs beyond limit + 1 are not followed."""

    def spare(word: str) -> float:
        f = fold(word)
        return 0.02 if len(f) == 1 or f in LEGAL or f in TITLES else 0.5

    def missing(token: str) -> float:
        return 0.02 if fold(token) in LEGAL else 0.25 if len(token) > 1 else 0.05

    n = len(name)
    best = {(0, False): 0.0}
    for word, short in words:
        after: dict[tuple[int, bool], float] = {}
        extra = spare(word)
        full = len(word) > 1
        fits = [(1 << j, c, rare[j] and full and not (short and c == 0.15)) for j in range(n) if (c := _fit(word, short, name[j], forms[j])) is not None]
        # two words of the name written as one
        for j in range(n - 1):
            if len(word) > max(5, len(name[j])) and (c := _fit(word, False, name[j] + name[j + 1], frozenset())) is not None:
                fits.append((3 << j, c + 0.05, rare[j] or rare[j + 1]))
        for (used, met), cost in best.items():
            options = [((used, met), cost + extra)]
            options += [((used | mask, met or tells), cost + c) for mask, c, tells in fits if not used & mask]
            for key, value in options:
                if value <= limit + 1 and value < after.get(key, 9.0):
                    after[key] = value
        best = after
        if not best:
            return None
    ends = [cost + sum(missing(name[j]) for j in range(n) if not used >> j & 1) for (used, met), cost in best.items() if met]
    return min(ends, default=None)


def readings(text: str) -> list[list[tuple[str, bool]]]:
    """The ways to read a text as name tokens: as it stands, and for a single word also as an initial glued to a name."""
    words = cut(text)
    out = [words]
    if len(words) == 1 and len(words[0][0]) >= 5:
        w = words[0][0]
        out.append([(w[0], False), (w[1:], False)])
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, key) of each distinct text."""
    for batch in batches:
        left, right = [], []
        for text in batch.column(0).to_pylist():
            found = {k for words in readings(text) for w, _ in words if len(w) > 1 and fold(w) not in LEGAL for k in deletions(fold(w))}
            left += [text] * len(found)
            right += sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["text", "key"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, canonical, name_no, place, token, folded) of each token of each name."""
    schema = pa.schema([("id", pa.string()), ("canonical", pa.bool_()), ("name", pa.string()), ("place", pa.int32()), ("token", pa.string()), ("folded", pa.string())])
    for batch in batches:
        rows = []
        for i, name, canonical in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            rows += [{"id": i, "canonical": canonical, "name": name, "place": p, "token": w, "folded": fold(w)} for p, (w, _) in enumerate(cut(name))]
        yield pa.RecordBatch.from_pylist(rows, schema)


def _costs(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, ident, tokens = (batch.column(c).to_pylist() for c in range(3))
        out = []
        for t, ts in zip(text, tokens, strict=True):
            ts = sorted(ts, key=lambda x: x["place"])
            name, forms, rare = [x["token"] for x in ts], [frozenset(x["forms"] or ()) for x in ts], [x["rare"] for x in ts]
            found = []
            for words in readings(t):
                c = align(words, name, forms, rare, limit)
                if c is not None:
                    found.append(c)
            out.append(round(min(found), 3) if found else None)
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(ident, pa.string()), pa.array(out, pa.float64())], ["text", "id", "cost"])


def link(mentions: DataFrame, entities: DataFrame, key_col: str = "mention_key", text_col: str = "text", limit: float = LIMIT, nicknames: DataFrame | None = None) -> DataFrame:
    """(mention key, entity_id, cost): the mentions whose text names exactly one entity.

    entities: (id, canonical_name, aliases); nicknames: further short forms of names (full, nick), folded, if the caller has
    any. Null or blank texts, keys, ids and names take no part; a key that repeats with
    another text is linked only if its texts agree on one entity; equally cheap entities leave a text without a link. A word
    that belongs to no name costs 0.5, so texts of many words are names of nothing.
    """
    one = entities.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), F.col("canonical_name").alias("name"), F.lit(True).alias("canonical"))
    other = entities.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), F.explode("aliases").alias("name"), F.lit(False).alias("canonical"))
    tokens = one.unionByName(other).where(F.col("name").isNotNull()).distinct().mapInArrow(_tokens, "id string, canonical boolean, name string, place int, token string, folded string")
    tokens = checkpointed(tokens)
    frequency = tokens.groupBy("folded").agg(F.count_distinct("id").alias("df"))
    # nicknames: aliases that differ from the canonical name in their first word alone
    first = tokens.where("place = 0 and length(folded) > 1").alias("a")
    rest = tokens.groupBy("id", "canonical", "name").agg(F.array_sort(F.collect_set(F.when(F.col("place") > 0, F.col("folded")))).alias("rest"))
    heads = first.join(rest, ["id", "canonical", "name"]).where(F.size("rest") > 0)
    learned = (
        heads.where("canonical").select("id", "rest", F.col("folded").alias("full"))
        .join(heads.where("not canonical").select("id", "rest", F.col("folded").alias("nick")), ["id", "rest"])
        .where("full <> nick").select("full", "nick").distinct()
    )
    learned = learned if nicknames is None else learned.unionByName(nicknames.select("full", "nick")).distinct()
    forms = learned.unionByName(learned.select(F.col("nick").alias("full"), F.col("full").alias("nick"))).groupBy("full").agg(F.collect_set("nick").alias("forms"))
    # distinctive are the rarest tokens, given names and words of law aside if there is any other
    telling = F.col("full").isNull() & (F.length("folded") > 1) & ~F.col("folded").isin(*LEGAL, *TITLES)
    each = Window.partitionBy("id", "name")
    known = tokens.join(frequency, "folded").join(forms, F.col("folded") == F.col("full"), "left").withColumn("telling", telling)
    least = known.withColumn("least", F.min(F.when(F.col("telling"), F.col("df"))).over(each)).withColumn("any", F.min(F.when(F.length("folded") > 1, F.col("df"))).over(each))
    rare = F.when(F.col("least").isNotNull(), F.col("telling") & (F.col("df") <= F.greatest(F.col("least"), F.lit(RARE)))).otherwise((F.length("folded") > 1) & (F.col("df") == F.col("any")))
    rated = least.withColumn("rare", F.coalesce(rare, F.lit(False))).select("id", "name", "place", "token", "folded", "forms", "rare")
    rated = checkpointed(rated)
    names = rated.groupBy("id", "name").agg(F.collect_list(F.struct("place", "token", "forms", "rare")).alias("tokens"))
    shorter = F.expr("transform(sequence(1, length(folded)), i -> concat(substr(folded, 1, i - 1), substr(folded, i + 1)))")
    keys = F.when(F.length("folded") >= 4, F.concat(F.array("folded"), shorter)).otherwise(F.array("folded"))
    index = rated.where("rare").select("id", "name", F.explode(keys).alias("key")).distinct()

    size = rated.agg(F.sum(F.when(F.col("rare"), F.length("folded") + 1)).alias("keys"), F.count("*").alias("tokens")).first()
    few = lambda df, n: F.broadcast(df) if (n or 0) * ROW_BYTES <= BROADCAST_BYTES else df

    spark = mentions.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = mentions.where(F.col(f"`{key_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{key_col}`").alias(key_col), F.col(f"`{text_col}`").alias("text")).distinct()
    # few bytes but costly: dealt to all tasks ahead of each pass in Python
    distinct = texts.select("text").distinct().repartition(tasks)
    met = distinct.mapInArrow(_keys, "text string, key string").join(few(index, size["keys"]), "key").select("text", "id", "name").distinct().repartition(tasks)
    costs = met.join(few(names, size["tokens"]), ["id", "name"]).select("text", "id", "tokens").mapInArrow(lambda it: _costs(it, limit), "text string, id string, cost double")
    best = (
        costs.where(F.col("cost") <= limit).groupBy("text").agg(F.min(F.struct("cost", "id")).alias("low"), F.max(F.struct((-F.col("cost")).alias("c"), "id")).alias("high"))
        .where("low.id = high.id").select("text", F.col("low.id").alias("entity_id"), F.col("low.cost").alias("cost"))
    )
    return texts.join(best, "text").groupBy(key_col).agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("_most"), F.min("cost").alias("cost")).where("entity_id = _most").drop("_most")
