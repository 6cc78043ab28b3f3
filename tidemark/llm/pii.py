"""Personal data: fixed patterns, and bootstrapped contexts that find identifiers the patterns do not know.

Matches of the fixed patterns are seeds, and so are a few tokens that look like keys: at most ``SEEDS`` from each of the
``FAMILIES`` left contexts in which most such tokens stand. What stands around seeds and around other identifier-like tokens
makes a graph of lexical patterns and instances. Spark scores it in rounds, and the instances met in patterns of high
confidence are added: any token that stands where identifiers stand is, whatever its shape, and a key-like one that is no
seed and that no pattern reaches is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

KINDS = ("email", "ip", "card", "phone")
#: The kind of spans that only their context gives away.
FOUND = "context"
#: The belief in a seed that only looks like a key; so many of them are taken from each of so many contexts, and from those
#: only that hold at least LEAST_SEEDS of them.
KEY_BELIEF = 0.9
SEEDS, FAMILIES, LEAST_SEEDS = 8, 4, 5
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits starts, and takes whole runs: so each digit is looked at once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
#: What tokens are made of, and what is no part of them at their ends.
_RUN = re.compile(r"[A-Za-z0-9_.@%+:/~-]+")
_IN_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.@%+:/~-")
_EDGES = "_.%+:/~-"
_NAMED = re.compile(r"[A-Za-z]+:")
_SWITCH = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping: every match holds one "@", before it the longest run of local characters."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start and kind. A match that fails its test is dropped."""
    spans = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m.group())) <= 15]
    return sorted(spans)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with at least four digits, or with an "@" between other characters, of any length. A name and a colon before
    a token are no part of it. Every character is looked at a bounded number of times."""
    at = 0
    while mark := _MARK.search(text, at):
        lo = mark.start()
        while lo > at and text[lo - 1] in _IN_RUN:
            lo -= 1
        hi = at = _RUN.match(text, mark.start()).end()
        if named := _NAMED.match(text, lo, hi):
            lo = named.end()
        token = text[lo:hi]
        lo += len(token) - len(token.lstrip(_EDGES))
        hi -= len(token) - len(token.rstrip(_EDGES))
        if len(_DIGIT.findall(text, lo, hi)) >= 4 or "@" in text[lo + 1 : hi - 1]:
            yield lo, hi


def key_like(token: str) -> bool:
    """At least 32 letters and digits that change from one to the other six times or more."""
    return len(token) >= 32 and token.replace("-", "").replace("_", "").isalnum() and len(_SWITCH.findall(token)) >= 6


def _before(text: str, at: int, n: int) -> list[str]:
    """The n units before a place, the nearest first: words, numbers as 9, marks, line ends as ^."""
    units: list[str] = []
    while len(units) < n:
        while at and text[at - 1].isspace() and text[at - 1] != "\n":
            at -= 1
        end = at
        at -= at > 0
        if end and text[at].isalpha():
            while at and text[at - 1].isalpha():
                at -= 1
            units.append(text[at:end].lower())
        elif end and text[at].isdigit():
            while at and text[at - 1].isdigit():
                at -= 1
            units.append("9")
        else:
            units.append("^" if not end or text[at] == "\n" else text[at])
    return units


def _after(text: str, at: int) -> str:
    """The unit after a place: the word, a number as 9, the mark, or $ for the end of the line."""
    size = len(text)
    while at < size and text[at].isspace() and text[at] != "\n":
        at += 1
    if at == size or text[at] == "\n":
        return "$"
    end = at
    if text[at].isalpha():
        while end < size and text[end].isalpha():
            end += 1
        return text[at:end].lower()
    return "9" if text[at].isdigit() else text[at]


def shape(token: str) -> str:
    """Which of letters, digits and marks a token has, and the number of binary digits of its length."""
    classes = (any(map(str.isalpha, token)), any(map(str.isdigit, token)), "@" in token, not token.isalnum())
    return "".join(c for c, there in zip("a9@-", classes, strict=True) if there) + str(len(token).bit_length())


def patterns(text: str, start: int, end: int) -> list[str]:
    """The three units before; the two before and the shape; the units on either side and the shape."""
    one, two, three = _before(text, start, 3)
    kind = shape(text[start:end])
    return [f"L {three} {two} {one}", f"S {two} {one} {kind}", f"B {one} _ {_after(text, end)} {kind}"]


def _number(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def met(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """The base spans of a text, and (start, end, belief) of these and of all other candidates: 1 and 0."""
    if not _MARK.search(text):
        return [], []
    spans = base_spans(text)
    found = [(a, b, 1.0) for a, _, b in spans]
    taken = iter([*found, (len(text) + 1, len(text) + 1, 1.0)])
    a, b, _ = next(taken)
    for lo, hi in candidates(text):
        while b <= lo:
            a, b, _ = next(taken)
        if hi <= a:
            found.append((lo, hi, 0.0))
    return spans, found


def lettered(token: str) -> bool:
    """Whether a token is no mere number: it holds a letter or an "@"."""
    return "@" in token or any(map(str.isalpha, token))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (doc_id, key, base, seen): the base spans, and (start, end, instance, belief, key_like, lettered, contexts) of all
    candidates."""
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    flags = [(name, pa.bool_()) for name in ("key_like", "lettered")]
    seen_kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("belief", pa.float64()), *flags, ("contexts", pa.list_(pa.int64()))])
    for batch in batches:
        base, seen = [], []
        for value in batch.column(2):
            text = value.as_py()
            spans, found = met(text)
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            seen.append(
                [{"start": a, "end": b, "instance": _number(text[a:b].lower()), "belief": s, "key_like": key_like(text[a:b]), "lettered": lettered(text[a:b]), "contexts": list(map(_number, patterns(text, a, b)))} for a, b, s in found]
            )
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, pa.list_(span)), pa.array(seen, pa.list_(seen_kind))], ["doc_id", "key", "base", "seen"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = common.string_or_empty("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def key_seeds(edges: DataFrame) -> DataFrame:
    """(instance) of the key-like tokens that are seeds, from (context, instance) of such tokens in their left contexts.

    At most FAMILIES x SEEDS: of the contexts with most different ones (ties to the smaller hash) those of least hash.
    """
    distinct = edges.distinct()
    families = distinct.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEDS).orderBy(F.desc("n"), "context").limit(FAMILIES)
    inside = distinct.join(F.broadcast(families.select("context")), "context")
    place = F.row_number().over(Window.partitionBy("context").orderBy("instance"))
    # Spark keeps the first rows of each context only, before the shuffle too.
    return inside.withColumn("place", place).where(F.col("place") <= SEEDS).select("instance").distinct()


def confident(edges: DataFrame, *, rounds: int = 3, trust: float = 0.8, prior: float = 1.0) -> DataFrame:
    """(instance, score) of the instances that are no base spans, from the graph (context, instance, belief, neutral).

    A context is worth the summed standing of its distinct instances over that sum, the other instances and a prior; where
    an edge is ``neutral`` (all are not, without that column) an instance without any standing is not counted. An instance
    scores the chance that one of its contexts worth ``trust`` at least is right; it stands at that or at its belief,
    whichever is more. Belief 1 is a base span and stays. The graph has each pair once, so a common instance or context is
    one line for each of its different partners; sums are taken before the shuffle, and Spark splits what is still skewed.
    """
    neutral = F.col("neutral") if "neutral" in edges.columns else F.lit(False)
    graph = common.checkpointed(edges.groupBy("context", "instance").agg(F.max("belief").alias("belief"), F.max(neutral).alias("neutral")))
    scores = graph.groupBy("instance").agg(F.max("belief").alias("belief")).withColumns({"score": F.lit(0.0), "standing": F.col("belief")})
    for _ in range(rounds):
        worth = graph.select("context", "instance", "neutral").join(scores.select("instance", "standing"), "instance")
        # A neutral instance counts for as much as it stands at, any other for one.
        weight = F.when(F.col("neutral"), F.col("standing")).otherwise(F.lit(1.0))
        worth = worth.groupBy("context").agg((F.sum("standing") / (F.sum(weight) + prior)).alias("worth")).where(F.col("worth") >= trust)
        doubt = graph.where("belief < 1").join(worth, "context").groupBy("instance").agg(F.exp(F.sum(F.log1p(-F.least("worth", F.lit(0.999))))).alias("doubt"))
        scores = scores.select("instance", "belief").join(doubt, "instance", "left").select("instance", "belief", (1 - F.coalesce("doubt", F.lit(1.0))).alias("score"))
        scores = common.checkpointed(scores.withColumn("standing", F.greatest("belief", "score")))
    return scores.where("belief < 1").select("instance", "score", "belief")


def spans(docs: DataFrame, *, rounds: int = 3, trust: float = 0.8, accept: float = 0.8, keys: bool = True) -> DataFrame:
    """(doc_id, key, base, found, discovered) for each row: spans array<struct<start, kind, end>> of code points, end exclusive.

    ``base`` are the matches of the fixed patterns, ``kind`` numbers KINDS; ``found`` are other candidates whose score
    reaches ``accept``, ``discovered`` how many of these are no seeds. Without ``keys`` only base spans are seeds. Spans
    never overlap base spans. ``key`` is the hash of the text.

    * a null text counts as empty; a null doc_id is kept; repeated rows stay repeated and have the same spans;
    * texts and tokens of any length are searched whole, in time in proportion to their length;
    * equal scores are treated alike; an empty table gives an empty result; further columns are ignored.
    """
    common.ship(docs.sparkSession)
    seen_kind = "start: bigint, end: bigint, instance: bigint, belief: double, key_like: boolean, lettered: boolean, contexts: array<bigint>"
    rows = common.checkpointed(_keyed(docs).mapInArrow(_extract, f"doc_id long, key long, base array<struct<start: bigint, kind: int, end: bigint>>, seen array<struct<{seen_kind}>>"))
    seen = rows.select("doc_id", "key", F.explode("seen").alias("s")).select("doc_id", "key", "s.*")
    # The first context is the left one, whatever the shape; in the others, of one shape each, what is no number and no seed
    # speaks neither for nor against.
    edges = seen.select(F.posexplode("contexts").alias("place", "context"), "instance", "belief", "lettered")
    edges = edges.select("context", "instance", "belief", ((F.col("place") > 0) & F.col("lettered")).alias("neutral"))
    if keys:
        seeds = key_seeds(seen.where("key_like AND belief < 1").select(F.get("contexts", F.lit(0)).alias("context"), "instance")).withColumnRenamed("instance", "seed")
        edges = edges.join(F.broadcast(seeds), F.col("instance") == F.col("seed"), "left").withColumn("belief", F.when(F.col("seed").isNull(), F.col("belief")).otherwise(F.greatest("belief", F.lit(KEY_BELIEF)))).drop("seed")
    scores = confident(edges, rounds=rounds, trust=trust).where(F.col("score") >= accept)
    met = seen.where("belief < 1").join(scores.select("instance", (F.col("belief") == 0).alias("new")), "instance")
    met = met.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end", "new"))).alias("found"))
    met = met.select(F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key"), "found")
    same = rows.doc_id.eqNullSafe(met.of_doc) & (rows.key == met.of_key)
    plain = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    found = F.coalesce(plain, F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")).alias("found")
    discovered = F.coalesce(F.size(F.filter("found", lambda s: s["new"])), F.lit(0)).cast("long").alias("discovered")
    return rows.join(met, same, "left").select("doc_id", "key", "base", found, F.when(F.col("found").isNull(), 0).otherwise(discovered).cast("long").alias("discovered"))


def count_of(column: str, kind: int):
    """How many of the spans are of a kind."""
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")


def as_text(column):
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, FOUND)])
    return F.array_join(F.transform(F.array_sort(column), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            batch, out = whole.slice(lo, 256), []
            for value, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = value.as_py()
                marks = base_spans(text) if _MARK.search(text) else []
                marks = sorted([*marks, *((s["start"], s["kind"], s["end"]) for s in found or ())])
                parts, done = [], 0
                for start, kind, end in marks:
                    if start >= done:
                        parts += [text[done:start], f"<{(*KINDS, FOUND)[kind].upper()}>"]
                    done = max(done, end)
                out.append("".join(parts) + text[done:] if marks else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])


#: Found spans that are sent to every executor at most; beyond it the texts are joined by shuffling.
SENT_SPANS = 100_000


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets, and n_chars (if there) counted anew.

    All columns and rows stay, whatever their names. Spans that overlap are replaced once, by the kind of the first.
    """
    rest = [c for c in docs.columns if c != "text"]
    text = common.string_or_empty("text")
    # The columns of the documents are packed, so that their names cannot clash with those used here.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), text.alias("text"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"))
    found = common.checkpointed(spans(docs).where(F.size("found") > 0).select(F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key"), "found").distinct())
    if (found.agg(F.sum(F.size("found"))).first()[0] or 0) <= SENT_SPANS:
        found = F.broadcast(found)
    joined = packed.join(found, F.col("id").eqNullSafe(F.col("of_doc")) & (F.col("key") == F.col("of_key")), "left").select("row", "text", "found")
    done = joined.mapInArrow(_masked, joined.drop("found").schema)
    out = {c: F.col(f"row.`{c}`") for c in rest} | {"text": F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return done.select(*[out[c].alias(c) for c in docs.columns])
