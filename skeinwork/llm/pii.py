"""Personal information in free text by bootstrapped contextual extraction, and its replacement by typed placeholders.

1. Candidates are spans of a permissive shape: e-mail addresses (also written out), runs of digits with separators, street
   addresses, and sequences of capitalised words or initials. Each comes with its context patterns: the words before and
   after it within the sentence, and its own shape with digits and letters masked.
2. Seeds are candidates whose form or place is beyond doubt: full e-mail addresses, phone numbers with a country or area
   prefix, identity numbers of fixed formats, addresses with a street word, and capitalised words after a title, greeting,
   closing or field label, or that an e-mail address in the same text is made of. No list of names is used.
3. The graph of instances and patterns is scored in rounds: a pattern's score for a type is the share of its instances that
   are of that type (where instances without a type yet say little, they count a tenth); an instance that is no seed gets the
   score of the patterns it occurs in. For persons the words of the name are patterns, too, so a name that a seed has taught
   is known in other contexts, and teaches those. High-scoring patterns so discover instances, those raise further patterns,
   and so on. Numbers of unseen shape get a type from their contexts, and other contexts from their shapes.
4. A candidate is accepted by its own score; of overlapping ones the best, then the longest, is kept.

Every text is read in whole by one pass in Python; scoring is joins and aggregations on pattern counts that are combined
before each shuffle, so that a pattern that a third of all candidates share arrives as one row per task. Lineage is cut after
extraction, since candidates are used in every round.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.session import cut, small, spread

TYPES = ("email", "phone", "id_number", "address", "person")
ROUNDS, ACCEPT, SUPPORT, UNTYPED = 3, 0.5, 3, 0.1
#: What stands right before a name, in eight languages: titles, greetings, closings, and labels of fields.
TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Herr|Herrn|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sr|Sra|Senhor|Senhora|Signor|Signora|Sig|Dott|Meneer|Mevrouw|Dhr|Mevr|Pan|Pani)\.?"
GREETING = r"(?:Hi|Hello|Hey|Dear|Hallo|Lieber?|Guten Tag|Sehr geehrter?|Bonjour|Salut|Ch[eè]re?|Hola|Estimad[oa]|Querid[oa]|Olá|Car[oa]|Ciao|Gentile|Beste|Geachte|Cześć|Drog[ia]|Szanown[ya])"
CLOSING = r"(?:(?:Kind |Best |Warm )?[Rr]egards|Best wishes|Best|Cheers|Sincerely|Yours|Signed|Thanks|(?:Viele |Beste |Liebe )?Gr(?:ü|ue)(?:ß|ss)e|Gezeichnet|Cordialement|Signé|Saludos|Atentamente|Firmado|Cumprimentos|Atenciosamente|Assinado|Cordiali saluti|Saluti|Firmato|Groeten|Met vriendelijke groet|Getekend|Pozdrawiam|Podpisano)"
LABEL = r"(?:(?:[Mm]y |[Ff]ull |[Ff]irst )?[Nn]ame(?: is)?|Author|Contact|From|Owner|Assignee|Reviewer|Autor|Autorin|Kontakt|Absender|Verfasser|[Mm]ein Name ist|Auteur|Nom|[Jj]e m'appelle|Nombre|[Mm]e llamo|Nome|[Mm]eu nome é|Autore|[Mm]i chiamo|Naam|[Mm]ijn naam is|Imię|[Nn]azywam się)"
_CUE = re.compile(rf"(?:(?<!\w)(?:{TITLE} |{GREETING},? |{CLOSING},\s+|{LABEL}:? ))$")
#: Small words inside names.
_LINK = r"(?:(?:van|von|de|der|den|la|le|da|di|dos|del|della|du|af|zu|ter|ten|bin|al) )"
#: Capitalised words that are no part of a name: articles, pronouns, prepositions, openers of sentences and letters, days, months.
NOT_NAMES = frozenset(
    """a an and are as at before between both build call can change checksum commit could dear did do does done each every first for from has have
    hello here hi how if in installed into is it its just last let look my need new next no node not now of on one only or our please regards
    reply right see send ship should show signed since so some still support thanks that the their then there these they this those to two under
    update use wait was we were what when where which while who why will with wrong whenever until although because during however right every once yes yesterday you your mr mrs ms dr prof sir
    ich du er sie es wir ihr der die das den dem ein eine einen einer meine mein unser unsere und oder aber in im am an auf bei mit nach von vor zu zum
    kannst können wenn was wo wie warum außerdem anschrift adresse telefon ausweisnummer vertrag herr frau
    je tu il elle nous vous le la les un une des du de ce cet cette ces mon ma mes et ou mais dans sur avec pour par que qui peux
    yo el los las un una este esta y o pero en con por para que creo también quedaban
    eu o os a as um uma esta e ou mas em com por para que acho também ainda
    io lo gli il un uno questo questa e ma nel nella con per che credo abbiamo restavano
    ik je hij wij we het de een dit deze en of maar met voor van op te ook er kun
    ja ty on ona my w we na z ze do i lub ale że czy myślę zauważyliśmy zostało ten ta to
    monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december""".split()
)
#: Capital letters of the Latin, Greek and Cyrillic scripts.
_CAP = "".join(c for c in map(chr, range(0x530)) if c.isupper())
_W = rf"[{_CAP}][^\W\d_]+(?:['’][^\W\d_]+)?(?:-[{_CAP}][^\W\d_]+)*"
_CITY = rf"[{_CAP}][^\W\d_]+(?:-[{_CAP}]?[^\W\d_]+)*"
_EMAIL = re.compile(r"(?<![\w.+/@-])[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}(?![\w@/-])")
_SPELT = re.compile(r"(?<![\w.+/@-])[A-Za-z0-9][\w.+-]* ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]+)+(?![\w@-])", re.I)
_NUMBER = re.compile(r"(?<![\w.+/@:#-])(?:[A-Z]{2}(?: ?\d\d){3} ?[A-Z]|[A-Z]\d{1,3}[A-Z]\d{4,6}|\d{7,9}[A-Z]|[+(]?\d(?:(?:\) ?|[ .\-/])?\d){6,19})(?![\w-]|[./:]\d)")
_STREET_WORD = r"(?:[Ss]tra(?:ß|ss)e|[Ss]tr\.|[Ww]eg|[Pp]latz|[Gg]asse|[Aa]llee|Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Court|Ct\.?|Place|Square|Close|Way|rue|avenue|chemin|boulevard|place|Calle|Avenida|Plaza|Via|Viale|Piazza|Rua|ul\.|al\.|os\.|straat|laan|PO Box|P\.O\. Box|Postfach)"
_PART = rf"(?:, (?:[^\W\d_]{{2,9}}\.? \d{{1,4}}[A-Za-z]?|\d{{1,3}}[ºª°]? ?[A-Z]?))?"
_ADDRESS = (
    # number first: 224b Fennelgate Road, Flat 24, Brindlemouth / 139 chemin de Tamblewood, 65646 Santaluna
    re.compile(rf"(?<![\w.,/-])\d{{1,4}}[A-Za-z]? (?:[^\W\d_]+\.? (?:(?:de|du|des|la|le|del|d[aei]) )*)?(?:[{_CAP}][^\W\d_]+\.? ){{0,2}}[{_CAP}][^\W\d_]+\.?{_PART}, (?:\d{{4,5}}(?:-\d{{3}})? {_CITY}|\d\d-\d{{3}} {_CITY}|{_CITY}(?: \d{{4,6}}(?!\d| of\b))?)"),
    # street first: ul. Quillhaven 178/13, 37-931 Lipnowo / Calle Fennelgate 138, 3º B, 90583 Kaltenau / Harrowdownweg 72, 45101 Santaluna
    re.compile(rf"(?<![\w/-])(?:(?:ul\.|al\.|os\.|via|rua|calle|[{_CAP}][^\W\d_]+) ){{0,2}}[{_CAP}][^\W\d_]+\.?(?: [Ss]tr\.)? \d{{1,4}}[A-Za-z]?(?:/\d{{1,4}})?{_PART}, (?:\d{{4,5}}|\d\d-\d{{3}}) {_CITY}"),
    re.compile(rf"(?<![\w/-])(?:PO Box|P\.O\. Box|Postfach) \d{{1,6}}, (?:\d{{4,5}} {_CITY}|{_CITY}(?: \d{{4,6}})?)"),
)
_STREET = re.compile(_STREET_WORD)
_NAME = re.compile(rf"(?=(?<![\w@./-])(?:({_W} [{_CAP}]\. {_W})|({_W} {_LINK}{{0,2}}{_W})|([{_CAP}]\. {_LINK}{{0,2}}{_W})|({_W}, {_W}))(?![\w@]))")
_TITLED = re.compile(rf"(?<![\w@./-]){TITLE} ({_W})(?![\w@])(?! {_W})")
_SEED_PHONE = re.compile(r"\+\d|00\d\d |\(\d{2,4}\) ?\d")
_SEED_ID = re.compile(r"\d{3}-\d\d-\d{4}$|[A-Z]{2}\d{6}[A-Z]$")
#: Local parts of e-mail addresses that are made of two words.
_BOX = re.compile(r"([a-z]{2,})[._-]([a-z]{3,})")
_PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}


def _folded(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).lower()


def _shape(text: str) -> str:
    return re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", text))


def _mask(token: str) -> str:
    """A token in lower case with its numbers as 9; a very long one by a checksum of it."""
    masked = re.sub(r"\d+", "9", token.lower())
    return masked if len(masked) <= 64 else f"#{zlib.crc32(masked.encode())}"


def _words_before(text: str, line: int, end: int) -> Iterator[str]:
    """What lies between blanks before a place, from the nearest on; the first is what touches it, maybe nothing."""
    while True:
        at = text.rfind(" ", line, end)
        yield text[max(at + 1, line) : end]
        if at < line:
            return
        end = at


def _words_after(text: str, start: int, stop: int) -> Iterator[str]:
    while True:
        at = text.find(" ", start, stop)
        yield text[start : at if at >= 0 else stop]
        if at < 0:
            return
        start = at + 1


def contexts(text: str, start: int, end: int) -> tuple[str, str, str, str]:
    """The two words and the word before a span, and the two words and the word after it, within its sentence or line."""
    left: list[str] = []
    for i, token in enumerate(_words_before(text, text.rfind("\n", 0, start) + 1, start)):
        if len(left) == 2 or (i and token and token[-1] in ".!?"):
            break
        if token:
            left.insert(0, _mask(token))
    if not left and start:
        # at the beginning of a line, a line before it that ends in a comma or colon
        line = text.rfind("\n", 0, start)
        last = text[text.rfind("\n", 0, max(0, line)) + 1 : max(0, line)].rsplit(" ", 1)[-1] if not text[line + 1 : start].strip() else ""
        if last.endswith((",", ":")):
            left = ["^", _mask(last)]
    stop = text.find("\n", end)
    right: list[str] = []
    for i, token in enumerate(_words_after(text, end, stop if stop >= 0 else len(text))):
        if len(right) == 2:
            break
        if token:
            right.append(("" if i == 0 else " ") + _mask(token))
            if token[-1] in ".!?":
                break
    left, right = ["^"] * (2 - len(left)) + left, right + ["$"] * (2 - len(right))
    return " ".join(left), left[1], "|".join(right), right[0]


def _named(given: str, family: str, boxes: list[str]) -> bool:
    """Whether the letters of an e-mail address's local part hold a family name, and begin with the given name or its initial."""
    return len(family) >= 3 and any(family in b and (b.startswith((given, given[0])) or b.endswith(given)) for b in boxes)


def candidates(text: str) -> Iterator[tuple[str, int, int, str, str | None, str | None, str | None]]:
    """(class, start, end, shape, seed type, given name, family name) of each candidate; names, folded, of persons and e-mail addresses."""
    boxes = []
    for m in _EMAIL.finditer(text):
        box = m[0].split("@")[0].lower()
        boxes.append(re.sub(r"[^a-z]", "", box))
        two = _BOX.fullmatch(box)
        yield "email", m.start(), m.end(), "@", "email", two and two[1], two and two[2]
    for m in _SPELT.finditer(text):
        yield "email", m.start(), m.end(), "(at)", None, None, None
    for m in _NUMBER.finditer(text):
        run = m[0]
        seed = "id_number" if _SEED_ID.match(run) else "phone" if _SEED_PHONE.match(run) and len(re.sub(r"\D", "", run)) <= 14 else None
        yield "number", m.start(), m.end(), _shape(run), seed, None, None
        # a number may run into one that follows: what ends at a blank is a candidate too, if its shape is known
        for g in re.finditer(" ", run):
            if sum(c.isdigit() for c in run[: g.start()]) >= 7:
                yield "part", m.start(), m.start() + g.start(), _shape(run[: g.start()]), None, None, None
    for form, pattern in enumerate(_ADDRESS):
        for m in pattern.finditer(text):
            yield "address", m.start(), m.end(), f"form {form} {'street' if _STREET.search(m[0]) else 'plain'}", "address" if _STREET.search(m[0]) else None, None, None
    for m in _NAME.finditer(text):
        for g in range(1, 5):
            if m[g] and not any(w.lower() in NOT_NAMES for w in re.findall(r"[^\W\d_]{2,}", m[g]) if not w.islower()):
                first, last = reversed(m[g].split(", ")) if g == 4 else (m[g].split(" ")[0], m[g].split(" ")[-1])
                given, family = _folded(first), _folded(last)
                line = text.rfind("\n", 0, max(0, m.start(g) - 1)) + 1
                told = g != 4 and _CUE.search(text[max(line, m.start(g) - 40) : m.start(g)]) is not None
                yield "person", m.start(g), m.end(g), "name", "person" if told or _named(given, family, boxes) else None, None if g == 3 else given, family
    for m in _TITLED.finditer(text):
        if m[1].lower() not in NOT_NAMES:
            yield "person", m.start(1), m.end(1), "name", "person", None, _folded(m[1])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "message_no", "cls", "start", "end", "item", "seed", "l2", "l1", "r2", "r1", "shape", "given", "family"]
    schema = pa.schema([(n, pa.int32() if n in ("message_no", "start", "end") else pa.string()) for n in names])
    for batch in batches:
        rows = []
        for i, n, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            rows += [(i, n, cls, a, b, text[a:b], seed, *contexts(text, a, b), shape, given, family) for cls, a, b, shape, seed, given, family in candidates(text)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows) if rows else [[]] * len(names), schema, strict=True)], schema=schema)


def messages(df: DataFrame, id_col: str, messages_col: str) -> DataFrame:
    """(id, message_no, text) of every message with a text; rows without id take no part."""
    return df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("string").alias("id"), F.posexplode(f"`{messages_col}`").alias("p", "m")).select("id", (F.col("p") + 1).alias("message_no"), F.col("m.text").alias("text")).where("text <> ''")


def _edges(seen: DataFrame) -> DataFrame:
    """One row per combination and informative pattern: not the edge of a sentence alone, nor the shape that all persons share."""
    nodes = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), (F.when(F.col("given").isNull(), F.col(k)) if k == "family" else F.col(k)).alias("pattern")) for k in ("l2", "l1", "r2", "r1", "shape", "given", "family")))).alias("x")
    rows = seen.select("no", F.when(F.col("cls") == "part", "number").otherwise(F.col("cls")).alias("cls"), (F.col("cls") == "part").alias("part"), "n", "seed", nodes)
    return rows.select("no", "cls", "part", "n", "seed", "x.kind", "x.pattern").where(F.col("pattern").isNotNull() & ~F.col("pattern").rlike(r"^[\^$ |]*$|^\^ \^|^ ?[.,;:)\"'>]*\|?\$?$") & ~((F.col("cls") == "person") & (F.col("kind") == "shape")) & ((F.col("cls") == "person") | ~F.col("kind").isin("given", "family")))


def _scored(seen: DataFrame, rounds: int) -> DataFrame:
    """(cls, kind, pattern, type, score, n): the score of each context and shape for each type.

    seen has one row per combination of class, contexts, shape and seed type, with the number of candidates n.
    """
    edges = cut(_edges(seen.where("cls <> 'part'")))
    score = None
    for _ in range(rounds):
        # the types of combinations: by seed, else by the patterns scored so far
        if score is None:
            typed = edges.where("seed is not null").select("no", "kind", "pattern", "cls", (F.col("n") * 1.0).alias("w"), F.col("seed").alias("type"))
        else:
            typed = edges.join(_judged(edges, score), "no").select("no", "kind", "pattern", "cls", (F.col("n") * F.col("score")).alias("w"), "type")
        total = edges.groupBy("cls", "kind", "pattern").agg(F.sum("n").alias("n"))
        good = typed.groupBy("cls", "kind", "pattern", "type").agg(F.sum("w").alias("w"))
        known = good.groupBy("cls", "kind", "pattern").agg(F.sum("w").alias("all"))
        # instances of no type yet: for numbers, whose types exclude each other, and for the words of names they say little;
        # elsewhere they count in full
        unknown = F.greatest(F.col("n") - F.col("all"), F.lit(0.0)) * F.when((F.col("cls") == "number") | F.col("kind").isin("given", "family"), UNTYPED).otherwise(1.0)
        share = F.col("w") / (F.col("all") + unknown + 0.5)
        score = cut(good.join(total, ["cls", "kind", "pattern"]).join(known, ["cls", "kind", "pattern"]).select("cls", "kind", "pattern", "type", share.alias("score"), "n"))
    return score


def _judged(edges: DataFrame, score: DataFrame) -> DataFrame:
    """(no, type, score): the type of each combination. Seeds are certain; of others the wider context counts where it has
    support, the narrower one otherwise; the sides join by noisy-or, a shape with half its weight."""
    met = edges.where("seed is null").join(score.withColumnRenamed("n", "support"), ["cls", "kind", "pattern"])
    by = met.groupBy("no", "part", "type").agg(
        *(F.max(F.when((F.col("kind") == k) & ((F.col("support") >= SUPPORT) | ~F.lit(wide)), F.col("score"))).alias(k) for k, wide in (("l2", True), ("l1", False), ("r2", True), ("r1", False), ("shape", False), ("given", False), ("family", False)))
    )
    left, right = (F.coalesce(F.col(two), F.least(F.col(one), F.lit(0.9)), F.lit(0.0)) for two, one in (("l2", "l1"), ("r2", "r1")))
    known = F.coalesce("shape", F.lit(0.0))
    named = F.coalesce(F.greatest("given", "family"), F.lit(0.0))
    best = 1 - (1 - F.greatest(left, 0.8 * right)) * (1 - 0.6 * known) * (1 - 0.8 * named)
    # what is only a part of a run needs a shape that is known of whole ones
    best = F.when(F.col("part"), F.least(best, known)).otherwise(best)
    ranked = by.select("no", F.struct(best.alias("score"), known.alias("known"), "type").alias("b")).groupBy("no").agg(F.max("b").alias("b")).select("no", "b.type", "b.score", "b.known")
    return ranked.unionByName(edges.where("seed is not null").select("no", F.col("seed").alias("type"), F.lit(1.0).alias("score"), F.lit(1.0).alias("known")).distinct())


def found(df: DataFrame, id_col: str = "segment_id", messages_col: str = "messages", rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """(id, message_no, start, end, pii_type, pii_text, score): every item found, none overlapping another.

    Offsets are code points of the message's text. Null ids, messages and texts hold nothing; repeated rows count once. Seeds
    of every type are judged by their contexts and shapes like all others; a person counts only where a context speaks for it,
    whatever the name. An empty input gives no rows.
    """
    spans = cut(spread(messages(df, id_col, messages_col)).mapInArrow(_extract, "id string, message_no int, cls string, start int, end int, item string, seed string, l2 string, l1 string, r2 string, r1 string, shape string, given string, family string").distinct())
    key = ["cls", "seed", "l2", "l1", "r2", "r1", "shape", "given", "family"]
    counted = spans.groupBy(*key).agg(F.count("*").alias("n"))
    # a name that an e-mail address anywhere is made of is a seed, too
    boxes = spans.where("cls = 'email' and family is not null").select(F.explode(F.array(F.struct(F.col("given").alias("g"), F.col("family").alias("f")), F.struct(F.col("family").alias("g"), F.col("given").alias("f")))).alias("x")).select("x.g", "x.f").distinct()
    met = counted.join(small(boxes), (F.col("cls") == "person") & (F.col("given") == F.col("g")) & (F.col("family") == F.col("f")), "left")
    seen = cut(met.select(*key, "n", F.coalesce("seed", F.when(F.col("g").isNotNull(), "person")).alias("taught")).withColumn("no", F.monotonically_increasing_id()))
    # seeds teach contexts, but are themselves judged by them; the words of a name teach, too, but do not make a person
    score = _scored(seen.drop("seed").withColumnRenamed("taught", "seed"), rounds)
    blind = seen.withColumns({c: F.lit(None).cast("string") for c in ("seed", "given", "family")})
    judged = _judged(_edges(blind), score).where(F.col("score") >= accept)
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    hits = spans.alias("a").join(seen.join(judged, "no").alias("b"), same).select("a.id", "a.message_no", "a.start", "a.end", F.col("a.item").alias("pii_text"), F.col("b.type").alias("pii_type"), F.col("b.score").alias("score"), F.col("b.known").alias("known"))
    together = hits.repartition("id", "message_no").sortWithinPartitions("id", "message_no")
    return together.mapInArrow(_settle, "id string, message_no int, start int, end int, pii_type string, pii_text string, score double")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of overlapping spans the best: typed forms before persons, known shapes before others, longer before shorter.

    Reads spans sorted by message and holds those of one message at a time.
    """
    schema = pa.schema([("id", pa.string()), ("message_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pii_type", pa.string()), ("pii_text", pa.string()), ("score", pa.float64())])

    def best(rows: list[dict]) -> list[dict]:
        def order(r: dict) -> tuple:
            number = r["pii_type"] in ("phone", "id_number")
            return r["pii_type"] == "person", -round(r["known"], 1) if number else -1.0, r["start"] - r["end"], r["start"], r["pii_type"]

        taken: list[tuple[int, int]] = []
        keep = []
        for r in sorted(rows, key=order):
            at = bisect.bisect(taken, (r["start"], r["end"]))
            if (at == 0 or taken[at - 1][1] <= r["start"]) and (at == len(taken) or r["end"] <= taken[at][0]):
                taken.insert(at, (r["start"], r["end"]))
                keep.append({k: r[k] for k in schema.names})
        return keep

    held: list[dict] = []
    for batch in batches:
        out: list[dict] = []
        for r in batch.to_pylist():
            if held and (r["id"], r["message_no"]) != (held[0]["id"], held[0]["message_no"]):
                out += best(held)
                held = []
            held.append(r)
        yield pa.RecordBatch.from_pylist(out, schema)
    if held:
        yield pa.RecordBatch.from_pylist(best(held), schema)


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.string()), ("message_no", pa.int32()), ("text", pa.string()), ("replaced", pa.int32())])
    for batch in batches:
        out = []
        for i, n, text, spans in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            at, parts = 0, []
            for s in sorted(spans or [], key=lambda s: s["start"]):
                parts += [text[at : s["start"]], _PLACEHOLDER[s["pii_type"]]]
                at = s["end"]
            out.append((i, n, "".join([*parts, text[at:]]), len(spans or [])))
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out) if out else [[]] * 4, schema, strict=True)], schema=schema)


def masked(df: DataFrame, items: DataFrame, id_col: str = "segment_id", messages_col: str = "messages") -> DataFrame:
    """(id, message_no, text, replaced): every text with each item replaced by the placeholder of its type."""
    spans = items.groupBy(F.col("id").alias("_id"), F.col("message_no").alias("_no")).agg(F.collect_list(F.struct("start", "end", "pii_type", "pii_text")).alias("spans"))
    texts = messages(df, id_col, messages_col).distinct()
    # rows that repeat an id with another text must not get the first text's offsets
    fits = F.filter("spans", lambda s: F.expr("substr(text, 1, 0)").isNotNull() & (F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]) == s["pii_text"]))
    joined = texts.join(spans, (F.col("id") == F.col("_id")) & (F.col("message_no") == F.col("_no")), "left").select("id", "message_no", "text", fits.alias("spans"))
    return joined.mapInArrow(_replace, "id string, message_no int, text string, replaced int")
