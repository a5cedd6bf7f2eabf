"""Records whose own text is residue: unfilled templates, filler, error pages, demands for scripts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .mail import own_text
from .template import CODE, FILLER, GREETING, LIKELY, OTHER, SEED, bare, hinted, holes, labels, open_fields, opening, seeds, sentences, take_apart

_SCHEMA = "id long, key binary, variant binary, copy binary, kinds string, what string, seeded boolean, marked boolean, body binary, alone boolean, sender binary"
_TYPES = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.binary(), pa.bool_(), pa.binary())
_NAMES = ["id", "key", "variant", "copy", "kinds", "what", "seeded", "marked", "body", "alone", "sender"]


_REMEMBERED = 100_000  # sentences, some 500 bytes each


def _digest(text: str) -> bytes:
    """96 bits that stand for a template's words: equal for different ones with a chance below 1e-8 even among 10**10 templates."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).digest()


_NO_WORDS = _digest("")


def take_apart_texts(df: DataFrame, id_col: str, text_col: str, sender_col: str | None = None) -> DataFrame:
    """One row per sentence of each record's own text: id, template key, variant and the sentence itself (digests), slot kinds, what it is, whether the record has a seed line, whether a field is open.

    A variant is a template with the kinds of its slots. Code has no digests.
    `body`, the same for all sentences of a record after the greeting, stands
    for its sequence of templates; it is empty where the record cannot be a bare
    page (template.bare). The first of them has the `sender`, or the record's
    id where there is none. `alone`: the record has no other sentence.

    Null, empty and blank texts, and texts without own words, give no rows.
    Whole texts are read, whatever their length. What a sentence is taken apart
    into depends on the sentence alone: a task remembers the last _REMEMBERED.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[bytes, bytes, bytes, str]] = {}
        for batch in batches:
            cols: list[list] = [[] for _ in _NAMES]
            if len(known) > _REMEMBERED:
                known.clear()
            for i, text, sender in zip(*(batch.column(c).to_pylist() for c in range(3))):
                own = own_text(text)
                text = own.text
                parts = sentences(text)
                if own.notice and all(code for _, code, _ in parts):
                    text = own.notice  # nothing else to see: the notice is the page
                    parts = sentences(text)
                what = labels(parts) if parts and hinted(text, parts) else [CODE if code else OTHER for _, code, _ in parts]
                seeded = seeds(parts, what)
                greetings, own_rows = opening(parts), []
                for (sentence, code, _), w, marked in zip(parts, what, open_fields(parts)):
                    key = variant = copy = kinds = None
                    if not code:
                        if sentence not in known:
                            words, kinds = take_apart(sentence)
                            kinds = holes(words, kinds)
                            known[sentence] = _digest(words), _digest(f"{words}\n{kinds}"), _digest(sentence), kinds
                        key, variant, copy, kinds = known[sentence]
                    own_rows.append((i, key, variant, copy, kinds, w, seeded, marked))
                body = b"".join(r[1] or b"" for r in own_rows[greetings:])
                body = hashlib.blake2b(body, digest_size=12).digest() if bare(parts[greetings:]) else b""
                mark = hashlib.blake2b((sender or f"\0{i}").encode("utf-8", "surrogatepass"), digest_size=12).digest()
                for k, row in enumerate(own_rows):
                    for c, v in zip(cols, (*row, body if k >= greetings else None, len(own_rows) - greetings < 2, mark if k == greetings else None)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)

    sender = F.col(sender_col).cast("string") if sender_col else F.lit(None).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), sender.alias("sender")).where(F.col("text").isNotNull()).mapInArrow(run, _SCHEMA)


def _induced(other: DataFrame, page_share: float, repeats: int, rounds: int = 2) -> DataFrame:
    """The keys of page lines without known wording: templates that occur beside other sentences in at least `repeats` records,

    `page_share` of them with a line of known wording or, in later rounds, with
    a line induced before. Records of a single sentence say nothing about it.
    """
    beside = other.where(~F.col("alone"))
    found = None
    lit = beside.where("seeded").select("id").distinct()  # records with a page line
    for k in range(rounds):
        near = beside.where("seeded") if k == 0 else beside.join(lit, "id", "left_semi")
        asked = near.select("key").distinct()
        said = beside.join(asked, "key", "left_semi").select("key", "id", "seeded")
        if k:
            said = said.join(lit.withColumn("lit", F.lit(True)), "id", "left").withColumn("seeded", F.col("seeded") | F.coalesce("lit", F.lit(False)))
        counts = said.groupBy("key").agg(F.countDistinct("id").alias("docs"), F.countDistinct(F.when(F.col("seeded"), F.col("id"))).alias("lit"))
        keys = counts.where((F.col("docs") >= repeats) & (F.col("lit") >= page_share * F.col("docs"))).select("key")
        found = materialize(keys if found is None else keys.unionByName(found).distinct(), "induced")
        lit = materialize(other.where(F.col("body") != F.lit(b"")).join(found, "key", "left_semi").select("id").distinct(), "lit")
    return found


def repeated_pages(parts: DataFrame, page_share: float, copies: int, senders: int, constant: float) -> DataFrame:
    """The ids of bare records whose text is a page by its repetition: a body of at least `copies` records by `senders` senders, each sentence of which

    is hardly ever said elsewhere (`page_share` of its occurrences are in such
    bodies; ordinary sentences turn up beside others) and stays as it is (at
    most `constant` as many spellings as occurrences; notices that are filled
    in differ in every copy). Lines of known wording need no such evidence. Records without a sender count as one each.
    """
    told = parts.where(F.col("body").isNotNull())
    repeated = told.where(F.col("sender").isNotNull() & (F.col("body") != F.lit(b""))).groupBy("body").agg(F.count("*").alias("n"), F.countDistinct("sender").alias("by"))
    repeated = repeated.where((F.col("n") >= copies) & (F.col("by") >= senders)).select("body")
    lines = told.select("id", "key", "copy", "what", "body", "sender").join(repeated, "body")
    worded = F.col("what").isin(GREETING, FILLER, SEED, LIKELY) | (F.col("key") == F.lit(_NO_WORDS))
    inside = materialize(lines, "repeated")
    keys = inside.where(~worded).groupBy("key").agg(F.count("*").alias("inside"), F.countDistinct("copy").alias("spellings"))
    everywhere = told.where(~worded).join(keys.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("all"))
    closed = keys.join(everywhere, "key").where((F.col("inside") >= page_share * F.col("all")) & (F.col("spellings") <= F.greatest(constant * F.col("inside"), F.lit(1.0)))).select("key", F.lit(True).alias("closed"))
    bodies = inside.join(closed, "key", "left").groupBy("body").agg(F.bool_and(worded | F.coalesce("closed", F.lit(False))).alias("page"), F.bool_or("closed").alias("some")).where("page and some").select("body")
    return inside.where(F.col("sender").isNotNull()).join(bodies, "body", "left_semi").select("id")


def find_residue(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    filled_share: float = 0.0,
    blank_share: float = 0.7,
    page_share: float = 0.8,
    repeats: int = 3,
    sender_col: str | None = None,
    page_copies: int = 10,
    page_senders: int = 4,
    page_constant: float = 0.2,
) -> DataFrame:
    """The records that are residue: id column and `reason` (`unfilled`, `page`).

    Sentences of all records are aligned by their template (take_apart): the
    fixed words are the anchors, the gaps between them the slots. A slot is one
    that holds values if more than `filled_share` of the template's records - by
    default any - have a proper value there. A record that retains a variable
    name or an empty default in such a slot is `unfilled`, or a blank where at
    least `blank_share` have a value (estimated with one more of either kind, so
    that few records do not decide); for a hole after a word that needs another
    one (template.holes) equal sentences count once too, so that a failed mailing
    to many does not outvote the rest. A sentence that always shows a variable
    name, as one that speaks about templates does, is not, unless the field is
    open by itself (template.open_fields). Quotations and code are no slots.

    A record is a `page` if all its sentences, greeting and heading apart, are
    filler or lines of an error page or demand for scripts. Such lines are known
    by wording, or induced: see template.seeds and _induced. So is
    a record without any known wording whose whole text is an error template by
    its repetition: see repeated_pages (`page_copies`, `page_senders`,
    `page_constant`; only with a sender column, as one sender's circular is no page).

    Rows with a null id are kept under null; repeated ids are one record's
    sentences. Counting is map-side combined, the templates' statistics join on
    the template key; nothing is collected. An empty table gives no rows.
    """
    parts = materialize(take_apart_texts(df, id_col, text_col, sender_col), "sentences")
    counted = parts.where(F.col("key").isNotNull()).groupBy("key", "variant").agg(F.first("kinds").alias("kinds"), F.count("*").alias("n"), F.countDistinct("copy").alias("copies"))
    counted = materialize(counted, "templates")
    # only a template whose records differ has slots to judge by
    several = counted.groupBy("key").agg(F.count("*").alias("variants")).where("variants > 1").select("key")
    gaps = counted.join(several, "key").select("key", "variant", "n", "copies", F.posexplode(F.split("kinds", "")).alias("slot", "kind")).where(F.col("kind") != "")
    proper = lambda n: F.sum(F.when(F.col("kind") == "P", F.col(n)).otherwise(0))
    likely = lambda n: (proper(n) + 1) / (F.sum(n) + 2)
    slots = gaps.groupBy("key", "slot").agg((proper("n") / F.sum("n")).alias("proper"), likely("n").alias("likely"), likely("copies").alias("likely_once"))
    judged = gaps.where(F.col("kind").isin("V", "N", "B", "H")).join(slots, ["key", "slot"])
    blank = F.col("kind").isin("B", "H") & (F.col("likely") >= blank_share) | (F.col("kind") == "H") & (F.col("likely_once") >= blank_share)
    left = (F.col("kind").isin("V", "N") & (F.col("proper") > filled_share)) | blank
    bad = judged.where(left).select("variant").distinct()
    unfilled = parts.join(bad, "variant").select("id").unionByName(parts.where("marked").select("id")).distinct().withColumn("reason", F.lit("unfilled"))

    known = F.col("what").isin(GREETING, FILLER, SEED, LIKELY)
    other = parts.where((F.col("what") == "O") & (F.col("key") != F.lit(_NO_WORDS)) & F.col("body").isNotNull())
    induced = _induced(other, page_share, repeats)
    # records with a line of either kind; without a known one they have to be bare
    unworded = other.where(~F.col("seeded") & (F.col("body") != F.lit(b""))).join(induced, "key", "left_semi").select("id").distinct()
    suspects = parts.where("seeded").unionByName(parts.where(~F.col("seeded")).join(unworded, "id", "left_semi").select(*parts.columns))
    suspects = suspects.join(induced.withColumn("induced", F.lit(True)), "key", "left")
    fine = known | F.coalesce("induced", F.lit(False)) | (~F.col("seeded") & F.col("body").isNull())  # greetings of records that were not labelled
    pages = suspects.groupBy("id").agg(F.bool_and(fine).alias("page")).where("page").select("id", F.lit("page").alias("reason"))
    if sender_col:
        pages = pages.unionByName(repeated_pages(parts, page_share, page_copies, page_senders, page_constant).withColumn("reason", F.lit("page")))
    both = unfilled.unionByName(pages).groupBy("id").agg(F.max("reason").alias("reason"))
    return both.select(F.col("id").alias(id_col), "reason")
