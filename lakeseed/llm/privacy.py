"""Personal data: fixed patterns, and terms that reveal the protected entities they stand beside.

E-mail and IP addresses, card and phone numbers are protected entities. A term (a word of letters,
``MIN_LETTERS`` or more) discloses an entity as far as seeing the term tells of it: of the entity's own
information, log(N / n_c) for an entity in n_c of N texts, the pointwise mutual information with the term leaves
-log(chance), where chance is that of the entity in a text that holds the term. With n_t texts that hold the
term and n_ct that hold both, it is taken as n_ct / n_t, less by how weak the evidence is: each text with both
weighs ``NEAR`` / (``NEAR`` + d), d being the words between them at their nearest, and ``LEAST`` at least, and of
weights that sum up to E the chance is n_ct / n_t * E / (E + ``PRIOR``). So a name that stands right beside an
entity counts from one text on, one some words away from a few, one anywhere in the texts from many; how many other
texts the corpus holds without the term changes nothing. A term passes when the chance is ``CHANCE`` or
more, and more than without the term. Texts that are copies of each other count as one. Passing
terms are removed in the documents that hold the entity; entities are generalised to their kind. Documents
without an entity are left alone.

All of it is DataFrame operations. The counts cover all documents and whole texts. A null text holds
nothing; repeated rows count as often as they occur and give repeated results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseed.workspace import stored

KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns match what the plain forms match, but start only where such a match can start and never
#: go back, so texts of any length take linear time and a constant stack.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text needs for any match of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}

MIN_LETTERS = 4
#: The words at which a sighting weighs half, and the least weight, of 1000 for words side by side.
NEAR, LEAST = 5, 76
PRIOR, CHANCE = 500, 0.65
#: Matches that are placed at a time; the sums of so many are placed the same way.
BLOCK = 256
#: Rows of the broadcast that finds texts with copies, at most.
SLOTS = 1 << 20

SPAN = "array<struct<start: long, kind: int, end: long, value: string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def holds(kind: str, match: Column) -> Column:
    """Whether a match is one of the kind."""
    if kind == "ip":
        small = F.split(match, r"\.")
        short = F.transform(small, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p.cast("int")) <= 255))
    if kind == "card":
        return F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """The body of a value that is made once."""
    return F.transform(F.array(value), body)[0]


def _run_on(pairs: Column, begin: Column, item, kind: str) -> Column:
    """For each of some pairs (size, gap), in order, an item made of it and of the place it begins at."""
    start = F.struct(begin.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def add(acc: Column, pair: Column) -> Column:
        at = acc["at"] + pair["gap"]
        return F.struct((at + pair["size"]).alias("at"), F.concat(acc["out"], F.array(item(at, pair))).alias("out"))

    return F.aggregate(pairs, start, add)["out"]


def matches(text: Column, pattern: str, hint: str) -> Column:
    """An array of (start, value) of the pattern's matches: what lies between them gives their places.

    Arrays grow by copying, so matches are placed in blocks, which keeps texts of many matches cheap.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda part: F.length(part).cast("long"))
    pairs = _let(found, lambda f: F.zip_with(
        f, F.slice(between, 1, F.size(f)), lambda v, g: F.struct(v.alias("value"), g.alias("gap"), F.length(v).cast("long").alias("size"))
    ))
    kind, none = "struct<start: long, value: string>", F.array().cast("array<struct<start: long, value: string>>")

    def placed(blocks: Column) -> Column:
        sums = F.transform(
            blocks,
            lambda block: F.struct(
                F.lit(0).cast("long").alias("gap"), F.aggregate(block, F.lit(0).cast("long"), lambda n, p: n + p["gap"] + p["size"]).alias("size")
            ),
        )
        heads = _run_on(sums, F.lit(0).cast("long"), lambda at, _: at, "long")
        item = lambda at, pair: F.struct(at.alias("start"), pair["value"].alias("value"))
        return F.flatten(F.zip_with(blocks, heads, lambda block, head: _run_on(block, head, item, kind)))

    def cut(all_: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(all_), F.lit(BLOCK))
        return F.when(F.size(all_) > 0, _let(F.transform(steps, lambda at: F.slice(all_, at, BLOCK)), placed)).otherwise(none)

    return F.when(text.rlike(hint), _let(pairs, cut)).otherwise(none)


def base_spans(text: Column) -> Column:
    """All entities of a text as (start, kind number, end, value), in order."""

    def of(number: int, kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind], HINTS[kind]), lambda m: holds(kind, m["value"]))
        return F.transform(found, lambda m: _span(m["start"], number, m["value"]))

    return F.array_sort(F.concat(*(of(number, kind) for number, kind in enumerate(PATTERNS))))


def _span(start: Column, kind: int, value: Column) -> Column:
    end = start + F.length(value)
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def entity(span: Column) -> Column:
    """Kind and plain value of an entity, so that ways to write it are one."""
    plain = F.when(span["kind"] >= 2, _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], plain)


def scanned(documents: DataFrame) -> DataFrame:
    """doc_id, spans, and key (the same for copies) and text where there are any spans, written once."""
    rows = documents.select("doc_id", "text", F.when(F.col("text").rlike("[0-9@]"), base_spans(F.col("text"))).alias("spans"))
    some = F.size("spans") > 0
    rows = rows.select(
        "doc_id",
        F.coalesce("spans", F.array().cast(SPAN)).alias("spans"),
        F.when(some, F.xxhash64("text")).alias("key"),
        F.when(some, F.col("text")).alias("text"),
    )
    return stored(rows, "entities")


def mentions(rows: DataFrame) -> DataFrame:
    """key, entity for every entity in every text, once."""
    found = rows.where("key is not null").select("key", F.explode(F.transform("spans", entity)).alias("entity"))
    return found.distinct()


WORD = rf"\p{{L}}{{{MIN_LETTERS},}}+"


def terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def words_of(rows: DataFrame) -> DataFrame:
    """key, term, start, end, beside: the words outside entities of every different text that holds any, written once.

    ``beside`` holds the entities before and after the word, with the words between.
    """
    once = rows.where("key is not null").dropDuplicates(["key"])
    no, place = F.lit(None).cast("string"), ("key", "at.start", (F.col("at.start") + F.length("at.value")).alias("end"))
    words = once.select("key", F.explode(matches(F.col("text"), WORD, r"\p{L}")).alias("at"))
    words = words.select(*place, F.col("at.value").alias("word"), no.alias("entity"))
    held = once.select("key", F.explode("spans").alias("at")).select(*place, no.alias("word"), entity(F.col("at")).alias("entity"))
    is_word = F.col("word").isNotNull()
    forth = Window.partitionBy("key").orderBy("start", is_word, "entity").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("key").orderBy(F.desc("start"), is_word.desc(), F.desc("entity")).rowsBetween(Window.unboundedPreceding, 0)
    marked = words.union(held).withColumn("reach", F.max(F.when(~is_word, F.col("end"))).over(forth))
    # Entities may hold letters, whose words do not count.
    free = is_word & (F.coalesce("reach", F.lit(0)) <= F.col("start"))
    marked = marked.withColumn("free", free).withColumn("n", F.sum(F.col("free").cast("long")).over(forth))
    own = F.when(~is_word, F.struct("entity", "n", "start"))
    marked = marked.withColumn("left", F.last(own, True).over(forth)).withColumn("right", F.last(own, True).over(back))
    marked = marked.where("free and (right is null or right.start >= end)")
    beside = F.array(
        F.struct(F.col("left.entity").alias("entity"), (F.col("n") - 1 - F.col("left.n")).alias("d")),
        F.struct(F.col("right.entity").alias("entity"), (F.col("right.n") - F.col("n")).alias("d")),
    )
    return stored(marked.select("key", F.lower("word").alias("term"), "start", "end", F.col("word").alias("value"), beside.alias("beside")), "words")


def classes(rows: DataFrame) -> DataFrame:
    """entity, class, n_c: entities that stand in the same texts are one class, with the same terms."""
    marks = [F.bit_xor(F.xxhash64("key", F.lit(seed))) for seed in (0, 1)]
    return mentions(rows).groupBy("entity").agg(
        F.count("*").alias("n_c"), F.xxhash64(F.count("*"), *marks).alias("class")
    )


def spreads(marked: DataFrame, copies: DataFrame) -> DataFrame:
    """term, n_t: how many different texts hold each term, counted over all rows less the further copies."""
    every = marked.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    more = copies.where("copies > 1")
    slot = F.pmod("mark", F.lit(SLOTS))
    # At most so many slots leave only texts that may have copies; the join by their mark is exact.
    likely = marked.join(F.broadcast(more.select(slot.alias("slot")).distinct()), slot == F.col("slot"), "leftsemi")
    held = likely.select("mark", F.explode(terms(F.col("text"))).alias("term")).distinct()
    less = held.join(more, "mark").groupBy("term").agg(F.sum(1 - F.col("copies")).alias("n"))
    return every.union(less).groupBy("term").agg(F.sum("n").alias("n_t"))


def told(documents: DataFrame, words: DataFrame, classed: DataFrame, held: DataFrame) -> DataFrame:
    """class, term for every term that discloses the entities of the class."""
    marked = documents.where("text is not null").select(F.xxhash64("text").alias("mark"), "text")
    copies = stored(marked.groupBy("mark").agg(F.count("*").alias("copies")), "copies")
    total = max(copies.count(), 1)
    near = words.select("key", "term").distinct()
    # The texts with entities alone hold most terms too often; only the others are looked up in the corpus.
    local = near.groupBy("term").agg(F.count("*").alias("n_t"))
    most = held.join(classed.select("class", "n_c").distinct(), "class").where(F.col("n_c") < total)
    fewer = F.least("n_c", "n_t")
    possible = near.join(local, "term").join(most, "key").where(_discloses(total, fewer, 1000 * fewer))
    direct = words.select("key", "term", F.explode("beside").alias("by")).select("key", "term", "by.entity", "by.d")
    direct = direct.join(classed.select("entity", "class"), "entity").groupBy("key", "term", "class").agg(F.min("d").alias("d"))
    weight = F.greatest(F.lit(LEAST), F.coalesce(F.expr(f"{1000 * NEAR} div ({NEAR} + d)"), F.lit(LEAST)))
    pairs = possible.join(direct, ["key", "term", "class"], "left").groupBy("class", "n_c", "term", "n_t")
    pairs = pairs.agg(F.count("*").alias("n_ct"), F.sum(weight).alias("seen"))
    shown = _discloses(total, F.col("n_ct"), F.col("seen"))
    pairs = stored(pairs.where(shown).drop("n_t"), "disclosures")
    wanted = pairs.select("term").distinct()
    spread = spreads(marked, copies).join(wanted, "term")
    return pairs.join(spread, "term").where(shown).select("class", "term")


def disclosing(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """entity, term for every term that discloses the entity."""
    classed = classes(rows)
    held = mentions(rows).join(classed, "entity").select("key", "class").distinct()
    return classed.join(told(documents, words_of(rows), classed, held), "class").select("entity", "term")


def _discloses(total: int, n_ct: Column, seen: Column) -> Column:
    """Whether a term that n_ct texts hold beside the entity leaves little enough of the entity's information."""
    chance = n_ct / F.col("n_t") * (seen / (seen + PRIOR))
    return (chance >= CHANCE) & (chance * total > F.col("n_c"))


def found(documents: DataFrame) -> DataFrame:
    """doc_id, text (null without any span), base: the entities, spans: these and disclosing terms."""
    rows = scanned(documents)
    classed = classes(rows)
    held = stored(mentions(rows).join(classed, "entity").select("key", "class").distinct(), "held")
    with_entity = rows.where("key is not null")
    words = words_of(rows)
    passing = stored(told(documents, words, classed, held), "told")
    flagged = words.join(passing, "term").join(held, ["key", "class"]).select("key", "start", "end", "value").distinct()
    number = F.lit(len(KINDS) - 1).alias("kind")
    flagged = flagged.groupBy("key").agg(F.collect_list(F.struct("start", number, "end", "value")).alias("more"))
    marked = with_entity.join(flagged, "key", "left")
    every = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(SPAN))))
    marked = marked.select("doc_id", "text", F.col("spans").alias("base"), every.alias("spans"))
    plain = rows.where("key is null").select("doc_id", "text", F.col("spans").alias("base"), "spans")
    return marked.union(plain)


def judged(documents: DataFrame) -> DataFrame:
    """Counts and places of the entities and terms of every document."""
    rows = found(documents)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size("base") - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(PATTERNS)
    ]
    digest = F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return rows.select("doc_id", *counts, digest, written(F.col("spans")).alias("spans"))


def sanitised(documents: DataFrame) -> DataFrame:
    """doc_id, text of the documents that hold entities: entities become their kind, terms are removed."""
    rows = found(documents).where(F.size("base") > 0)
    # Of overlapping entities the first one stands for all.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    names = F.array(*(F.lit(f"[{kind.upper()}]") for kind in KINDS[:-1]), F.lit(""))

    def put(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        label = F.when(s["start"] >= acc["at"], F.element_at(names, s["kind"] + 1)).otherwise("")
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.concat(acc["out"], gap, label).alias("out"))

    made = F.aggregate("spans", start, put)
    tail = F.substring(F.col("text"), (made["at"] + 1).cast("int"), F.length("text"))
    return rows.select("doc_id", F.concat(made["out"], tail).alias("text"))
