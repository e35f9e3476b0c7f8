"""Personal data: base patterns, and terms that disclose them. DataFrame functions only.

Base spans are the matches of four patterns that pass their checks; their values are the protected entities. What else
a document says may give an entity away. For each term the corpus tells how well one who knows it can guess an entity:

    P(entity | term) = (n_both + prior * P(entity)) / (n_term + prior)

over whole documents, `prior` being imagined documents that hold the entity as often as any other does, so that one
document that term and entity happen to share proves nothing. In information: -log2 P(entity | term) bits are left to
guess of the entity's -log2 P(entity). A term discloses an entity if the guess succeeds with at least `guess`, and the
term at least doubles its chance. It is then masked at each of its places in the documents that hold the entity. What
it is generalised to is its class, all terms with the same first letters: counted like a term, and if the class
discloses too much itself, the term is removed. Terms are runs of letters and digits of any length.

Counting: a text with personal data counts once, however many rows have it; other rows count each. Entities that stand
in the same documents are one to the statistics, and so are terms; a document gives pairs of such sets, not of single
values. A term is held against entities only if it stands mostly in documents with personal data, which loses none.

Positions are code points, ends exclusive. Spark gives no positions of matches, so the text is split at them and
lengths are summed up, in blocks, as a fold copies what it has built at each step. The patterns are written so that a
scan is linear: a run of characters is tried once, at its start, and repetitions are possessive, which changes no match.

Defined cases: a null text counts as empty and has no spans; a null doc_id is kept; repeated rows get equal spans;
overlapping spans of two kinds are both reported, and masked as one stretch; terms stand outside base spans;
an empty table gives no rows; columns other than `doc_id` and `text` are carried by `sanitise`, not read elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_dealt, materialise, or_empty

# The base patterns, in the order in which their spans are listed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Scripts that put no spaces between words.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: A run of letters and digits of any length; in scripts without spaces each letter, as nothing tells where a word ends.
# Letters of ASCII are named first, as they are found quickly; no group is repeated, so that a long run takes no stack.
TERM = rf"[A-Za-z0-9[\p{{L}}\p{{N}}&&[^{UNSPACED}]]][A-Za-z0-9[\p{{L}}\p{{M}}\p{{N}}&&[^{UNSPACED}]]]*+|[\p{{L}}\p{{N}}&&[{UNSPACED}]]\p{{M}}*+"
#: The chance of a right guess from which a term discloses an entity, and the imagined documents of the prior.
GUESS, PRIOR = 0.5, 2.0
#: Letters that the words of a class share.
CLASS_LETTERS = 3
#: Elements that a fold takes at once, as its cost grows with their square.
FOLDED = 128

_MASKS = "array<struct<start:int,end:int,mask:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def in_folds(values: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of each stretch of FOLDED elements, as an array."""
    last = F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / FOLDED).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: use(F.slice(values, k * FOLDED + 1, FOLDED)))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of the non-negative whole numbers `values`: it combined (sum, greatest) with all before it."""

    def fold(some: Column) -> Column:  # one element more: what stands before the first
        return F.aggregate(some, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(combine(F.element_at(done, -1), x))))

    def lift(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(F.lit(0)), lambda done, p: F.concat(done, F.array(combine(F.element_at(done, -1), F.element_at(p, -1)))))
        lifted = F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda p, b: F.transform(F.slice(p, 2, FOLDED), lambda x: combine(b, x)))
        return F.flatten(lifted)

    return bound(in_folds(values, fold), lift)


def spans_between(found: Column, pieces: Column) -> Column:
    """`start, end, value` of the matches `found`, from the `pieces` of text that they part (one more than there are matches)."""
    # side by side, not by index: an index would split the text anew for each match
    parts = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(m.alias("value"), F.length(p).alias("gap")))

    def placed(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda p: p["gap"] + F.length(p["value"])), lambda a, b: a + b)
        return F.zip_with(parts, ends, lambda p, e: F.struct((e - F.length(p["value"])).alias("start"), e.alias("end"), p["value"].alias("value")))

    return bound(parts, placed)


def spans_of(text: Column, pattern: str) -> Column:
    """Start, end and value of each match of `pattern`."""
    return spans_between(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_ip(value: Column) -> Column:
    significant = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(significant, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _is_card(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, 1).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    luhn = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)
    return F.when(n.between(13, 19), luhn % 10 == 0).otherwise(F.lit(False))


_CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": _is_ip,
    "card": _is_card,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
#: What a text must hold for the pattern to match at all: a cheap look before the pattern runs.
_HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def _passing(spans: Column, kind: str) -> Column:
    """The spans that pass the kind's check, named by it, with the value as an entity's name."""
    passing = F.filter(spans, lambda s: _CHECKS[kind](s["value"]))
    return F.transform(passing, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def with_base(docs: DataFrame) -> DataFrame:
    """`doc_id`, `key` (the text's digest) and `text` where a text has base spans, and `base`: these spans, kind by kind."""
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        if hint := _HINTS[kind]:
            found = F.when(F.contains("text", F.lit(hint)), found).otherwise(F.array().cast("array<string>"))
        docs = docs.withColumn("__found", found)
        # only a text with a match is split, and only its spans are looked at
        spans = F.when(F.size("__found") > 0, _passing(spans_between(F.col("__found"), F.split("text", pattern, -1)), kind))
        docs = docs.withColumn(f"__{kind}", spans).drop("__found")
    nothing = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    docs = docs.withColumn("base", F.concat(*[F.coalesce(f"__{k}", nothing) for k in PATTERNS]))
    held = F.size("base") > 0
    return docs.select("doc_id", F.when(held, F.sha2("text", 256)).alias("key"), F.when(held, F.col("text")).alias("text"), "base")


def masked(text: Column, masks: Column, blank: bool = False) -> Column:
    """`text` with the spans `masks` (`start, end, mask`, in order) replaced; spans that meet get the first one's mask.

    With `blank` they are overwritten with spaces, as many as they are long.
    """

    def part(mask: Column, before: Column) -> Column:
        # a span begins where all before it have ended, or it only lengthens the stretch
        begin = F.greatest(before, mask["start"])
        new = F.repeat(F.lit(" "), F.greatest(mask["end"] - begin, F.lit(0))) if blank else F.when(mask["start"] >= before, mask["mask"]).otherwise("")
        return F.struct(before.alias("start"), begin.alias("end"), new.alias("mask"))

    def pieces(parts: Column) -> Column:
        def inside(first: Column) -> Column:
            # the stretch of these parts is cut out once, and the parts from it
            last = F.coalesce(F.try_element_at(parts, F.lit(-1))["end"], F.lit(0))
            return bound(F.substring(text, first + 1, last - first), lambda near: F.transform(parts, lambda p: F.concat(F.substring(near, p["start"] - first + 1, p["end"] - p["start"]), p["mask"])))

        return bound(F.coalesce(F.try_element_at(parts, F.lit(1))["start"], F.lit(0)), inside)

    def cut(ends: Column) -> Column:
        parts = F.zip_with(masks, F.slice(ends, 1, F.size(masks)), part)
        return F.concat(F.array_join(F.flatten(in_folds(parts, pieces)), ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

    return bound(F.concat(F.array(F.lit(0)), running(F.transform(masks, lambda m: m["end"]), F.greatest)), cut)


def protected_texts(base: DataFrame) -> DataFrame:
    """`doc, key, copies, text, entities` of each distinct text with base spans, which are blank; `doc` is a number of its own."""
    texts = base.filter("key is not null").groupBy("key").agg(F.count("*").alias("copies"), F.first("text").alias("text"), F.first("base").alias("base"))
    spans = F.sort_array(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("mask"))))
    texts = texts.withColumn("text", bound(spans, lambda x: masked(F.col("text"), x, blank=True)))
    entities = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["value"])))
    return materialise(texts.select(F.monotonically_increasing_id().alias("doc"), "key", "copies", "text", entities.alias("entities")))


def class_of(term: Column) -> Column:
    """The class that a term is generalised to: its first letters, but never all of them. No term has a star, so none is a class."""
    return F.concat(F.substring(term, F.lit(1), F.least(F.lit(CLASS_LETTERS), F.length(term) - 1)), F.lit("*"))


def terms_of(text: Column) -> Column:
    """The terms of a text and their classes, lower-cased, each once."""
    words = F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)
    return bound(F.array_distinct(words), lambda w: F.concat(w, F.array_distinct(F.transform(w, class_of))))


def disclosing_terms(docs: DataFrame, texts: DataFrame, guess: float = GUESS, prior: float = PRIOR) -> DataFrame:
    """`doc, term` of each term, or class of terms, that discloses an entity of the same text of `texts` too well."""
    same = F.bit_xor(F.xxhash64("doc")).alias("docs")  # names the set of documents
    entity = materialise(texts.select("doc", F.explode("entities").alias("entity")))
    entities = materialise(entity.groupBy("entity").agg(F.count("*").alias("n_entity"), same))
    terms = materialise(texts.select("doc", "copies", F.explode(terms_of(F.col("text"))).alias("term")))
    # whole documents of the whole corpus; a task gives a term one row, however many of its documents hold it
    frequency = docs.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_rows"))
    most = entities.agg(F.max("n_entity").alias("most"))
    extra = texts.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("extra"))
    n = docs.agg(F.count("*").alias("n")).join(extra).select((F.col("n") - F.col("extra")).alias("n")).join(most)
    n = materialise(n)
    # no term can disclose an entity as rare as this, not one in a single document either: most entities of long logs go here
    possible = F.col("n_entity") * (1 + prior / F.col("n")) >= guess * (1 + prior) - 1e-9
    entities = materialise(entities.join(F.broadcast(n)).filter(possible).select("entity", "docs", "n_entity"))
    protected = terms.groupBy("term").agg(F.count("*").alias("n_protected"), F.sum(F.col("copies") - 1).alias("extra"), same)
    known = protected.join(frequency, "term").withColumn("n_term", F.col("n_rows") - F.col("extra")).join(F.broadcast(n))
    # no entity stands beside the term more often than personal data does: all others cannot pass below
    able = F.col("n_protected") + prior * F.col("most") / F.col("n") >= guess * (F.col("n_term") + prior)
    known = materialise(known.filter(able).select("term", F.struct("docs", "n_term").alias("terms"), "n", "n_protected"))
    term = materialise(join_dealt(terms, known, ["term"], "n_protected").select("doc", "term", "terms", "n"))
    sets = join_dealt(entity, entities, ["entity"], "n_entity").select("doc", F.struct("docs", "n_entity").alias("entities")).distinct()
    chance = F.col("entities.n_entity") / F.col("n")
    likely = lambda n_both: (n_both + prior * chance) / (F.col("terms.n_term") + prior)
    met = term.select("doc", "terms", "n").distinct().join(sets, "doc")
    met = materialise(met.filter(likely(F.least("entities.n_entity", "terms.n_term")) >= guess))
    both = met.groupBy("terms", "entities", "n").agg(F.count("*").alias("n_both"))
    guilty = both.filter((likely(F.col("n_both")) >= guess) & (likely(F.col("n_both")) >= 2 * chance)).select("terms", "entities")
    told = met.join(guilty, ["terms", "entities"]).select("doc", "terms").distinct()
    return materialise(term.join(told, ["doc", "terms"]).select("doc", "term"))


def term_spans(docs: DataFrame, base: DataFrame, guess: float = GUESS, prior: float = PRIOR) -> DataFrame:
    """`key, terms`: for each text (by its digest) the spans of terms to mask, in order, with the mask of each."""
    texts = protected_texts(base)
    guilty = disclosing_terms(docs, texts, guess, prior)
    named = texts.join(guilty.select("doc").distinct(), "doc").select("doc", F.explode(spans_of(F.col("text"), TERM)).alias("s"))
    named = named.select("doc", F.lower("s.value").alias("term"), "s.start", "s.end").join(guilty, ["doc", "term"])
    classes = guilty.select("doc", F.col("term").alias("class"), F.lit("").alias("mask"))
    named = named.withColumn("class", class_of(F.col("term"))).join(classes, ["doc", "class"], "left")
    found = named.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.coalesce("mask", "class").alias("mask")))).alias("terms"))
    return materialise(found.join(texts.select("doc", "key"), "doc").select("key", "terms"))


def _joined(kinded: Column) -> Column:
    return F.array_join(F.transform(kinded, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, guess: float = GUESS, prior: float = PRIOR) -> DataFrame:
    """One row per row of `docs`: `doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans` (see the module)."""
    docs = docs.select("doc_id", or_empty("text").alias("text"))
    base = materialise(with_base(docs))
    terms = term_spans(docs, base, guess, prior)
    none = F.array().cast(_MASKS)
    plain = base.filter("key is null").select("doc_id", "base", none.alias("terms"))
    held = base.filter("key is not null").select("doc_id", "key", "base").join(terms, "key", "left")
    rows = plain.unionByName(held.select("doc_id", "base", F.coalesce("terms", none).alias("terms")))
    extra = F.transform("terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    kinded = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("doc_id", *map(_count, PATTERNS), F.sha2(_joined(kinded), 256).alias("base_sha256"), _joined(F.concat(kinded, extra)).alias("spans"))


def sanitise(docs: DataFrame, guess: float = GUESS, prior: float = PRIOR) -> DataFrame:
    """The rows of `docs` with personal data in `text` masked: base spans by their kind, terms by their class or nothing."""
    plain = docs.select("doc_id", or_empty("text").alias("text"))
    base = materialise(with_base(plain).filter("key is not null"))
    terms = term_spans(plain, base, guess, prior)
    own = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mask")))
    held = base.select("key", "base").dropDuplicates(["key"]).join(terms, "key", "left")
    masks = materialise(held.select(F.col("key").alias("__key"), F.sort_array(F.concat(own, F.coalesce("terms", F.array().cast(_MASKS)))).alias("__masks")))
    keyed = docs.withColumn("__key", F.sha2(or_empty("text"), 256)).join(masks.hint("merge"), "__key", "left")
    text = F.when(F.col("__masks").isNotNull(), masked(F.col("text"), F.col("__masks"))).otherwise(F.col("text")).alias("text")
    return keyed.select(*[(text if c == "text" else F.col(f"`{c}`")) for c in docs.columns])
