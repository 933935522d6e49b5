"""Benchmark decontamination by canonical templates.

Words become ids: letters are lowered, signs dropped, numbers, units and names give
typed placeholders. Windows of such words are hash-joined between documents and
benchmark items, and a matched window counts only if its slots agree with those of
the windows beside it: one item value stands for one document value. So a question
asked again with other numbers or names is caught, while text that merely has
numbers in the same places is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, without

WINDOW = 8
MIN_LITERAL = 4  # words of a window that are no placeholder
MIN_COVER = 0.5  # of an item's words
MIN_RUN = 20  # or so many of its words
MIN_EXACT = 3  # words of an item that is matched word by word, as it has too few literal ones
COMMON = 64  # items: of the windows of more of them, those that can't make a match by themselves propose none
SHARED: int | None = None  # a rule that a caller may set: windows of more items propose no match, but an item's rarest
FILTER_BITS = 24  # the broadcast filter has 2**24 bits (2 MB) at any size of the benchmark
# Units, lower case.
UNITS = "mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec min h hr hrs day days week weeks year years pct percent usd eur gbp dollars euros cents k c f w kw v mph kmh".split()
NUM, UNIT, NAME = 1, 2, 3
_U = np.uint64
_B = _U(0x100000001B3)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(1, n), base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_KIND = np.zeros(256, np.uint8)  # 0 sign, 1 white space, 2 lower or above ASCII, 3 upper, 4 digit
_KIND[[32, *range(9, 14)]] = 1
_KIND[97:123] = 2
_KIND[128:] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the kept bytes of data[start:end], from running sums."""
    n = np.cumsum(kept)
    weight = _powers(int(_B), int(n[-1]) + 1 if len(n) else 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(np.where(kept, (data.astype(_U) + _U(1)) * weight[np.maximum(n - 1, 0)], _U(0)), out=total[1:])
    before = np.concatenate([[0], n])[start]
    back = _powers(_inverse(int(_B)), int(before.max()) + 1 if len(before) else 1)
    return _mix((total[end] - total[start]) * back[before])


def canonical(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words of the texts data[offsets[i]:offsets[i + 1]] (UTF-8 bytes).

    doc: the text; code: the canonical word; alt: the same, but that a capitalised
    word which begins a sentence is a name too; raw: the word itself, signs dropped
    and A-Z lowered. Words of signs alone are left out. A number holds a digit; a unit
    is in UNITS and follows a number (or hangs on it); a name has one upper letter,
    first, with lower ones behind, and neither begins a text or line nor follows . ! ? :"""
    kind = _KIND[data]
    gap = kind == 1
    first = np.ones(len(data) + 1, bool)
    first[1:] = np.concatenate([gap, [True]])[:-1] if len(data) else True
    first[offsets] = True
    first = first[: len(data)] & ~gap
    start = np.flatnonzero(first)
    if not len(start):
        none = np.zeros(0, _U)
        return {"doc": np.zeros(0, np.int64), "code": none, "alt": none, "raw": none}
    stop = np.append(np.flatnonzero(gap), len(data))
    end = np.minimum(stop[np.searchsorted(stop, start)], offsets[np.searchsorted(offsets, start, "right")])
    doc = np.searchsorted(offsets, start, "right") - 1
    low = np.where(kind == 3, data + 32, data).astype(np.uint8)
    count = lambda x: (lambda c: c[end] - c[start])(np.concatenate([[0], np.cumsum(x)]))
    raw = _word_hash(low, start, end, kind > 1)
    small, upper, digit = count(kind == 2), count(kind == 3), count(kind == 4)
    number = digit > 0
    letters = _word_hash(low, start, end, (kind == 2) | (kind == 3))
    unit_bytes = [u.encode() for u in UNITS]
    joined = np.frombuffer(b"".join(unit_bytes), np.uint8)
    cuts = np.cumsum([0, *map(len, unit_bytes)])
    units = _word_hash(joined, cuts[:-1], cuts[1:], np.ones(len(joined), bool))
    is_unit = ~number & (small + upper > 0) & np.isin(letters, units)
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    previous = np.concatenate([[0], end[:-1]])
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | _STOP[data[end[:-1] - 1]] | (newline[start[1:]] > newline[previous[1:]])])
    lead = np.minimum(start + (kind[start] == 0), len(data) - 1)  # a quote or bracket may stand before
    capital = ~number & (upper == 1) & (small > 0) & (kind[lead] == 3)
    after_number = np.concatenate([[False], number[:-1] & (doc[1:] == doc[:-1])])
    code = raw.copy()
    code[capital & ~fresh] = NAME
    code[is_unit & after_number] = UNIT
    code[number] = NUM
    alt = np.where(capital & fresh, _U(NAME), code)
    keep = small + upper + digit > 0
    return {"doc": doc[keep], "code": code[keep], "alt": alt[keep], "raw": raw[keep]}


def _windows(doc: np.ndarray, x: np.ndarray, size: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows of `size` words of one text; without exact those of few literal words are left out."""
    n = len(doc) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at, h = np.arange(n), np.full(n, int(exact), _U)
    ok = doc[at] == doc[at + size - 1]
    if not exact:
        literal = np.concatenate([[0], np.cumsum(x > 3)])
        ok &= literal[at + size] - literal[at] >= MIN_LITERAL
    for k in range(size):
        h = _mix(h * _B + x[k : k + n] + _U(k + 1))
    return at[ok], h[ok]


def _gathered(words: dict[str, np.ndarray], n_docs: int, wanted: list[tuple[str, int, np.ndarray | None]]) -> dict[str, np.ndarray]:
    """Windows by (codes, size, texts or None for all): start, size, hash, doc, at (within the text) and codes (0 code, 1 alt, 2 raw).

    Windows of alt are those that differ from the ones of code."""
    doc = words["doc"]
    begin = np.searchsorted(doc, np.arange(n_docs + 1))
    changed = np.concatenate([[0], np.cumsum(words["alt"] != words["code"])])
    parts = []
    for name, size, texts in wanted:
        start, h = _windows(doc, words[name], size, name == "raw")
        if name == "alt":
            own = changed[start + size] > changed[start]
            start, h = start[own], h[own]
        if texts is not None:
            own = texts[doc[start]]
            start, h = start[own], h[own]
        parts.append((start, np.full(len(start), size), h, np.full(len(start), ("code", "alt", "raw").index(name))))
    start, size, h, codes = (np.concatenate(x) for x in zip(*parts))
    return {"start": start.astype(np.int64), "size": size, "hash": h.astype(_U), "doc": doc[start.astype(np.int64)], "at": start - begin[doc[start.astype(np.int64)]], "codes": codes}


def item_windows(words: dict[str, np.ndarray], n_docs: int) -> dict[str, np.ndarray]:
    """An item's windows of WINDOW canonical words; a shorter item is one window. An item for which none has literal words enough is matched word by word."""
    length = np.bincount(words["doc"], minlength=n_docs)
    sizes = [WINDOW, *sorted({int(n) for n in length if MIN_LITERAL <= n < WINDOW})]
    fits = lambda n: length >= n if n == WINDOW else length == n
    found = _gathered(words, n_docs, [(name, n, fits(n)) for n in sizes for name in ("code", "alt")])
    bare = np.ones(n_docs, bool)
    bare[found["doc"]] = False
    bare &= length >= MIN_EXACT
    short = sorted({min(WINDOW, int(n)) for n in length[bare]})
    if not short:
        return found
    exact = _gathered(words, n_docs, [("raw", n, bare & fits(n)) for n in short])
    return {k: np.concatenate([v, exact[k]]) for k, v in found.items()}


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


ROWS = "id long, n_words int, at int, size int, exact boolean, hash long, codes binary, raws binary"
_rows_arrow = pa.schema([("id", pa.int64()), ("n_words", pa.int32()), ("at", pa.int32()), ("size", pa.int32()), ("exact", pa.bool_()), ("hash", pa.int64()), ("codes", pa.binary()), ("raws", pa.binary())])


def _template_windows(known: np.ndarray | None = None, sizes: list[tuple[int, bool]] = (), step: int = 1 << 20):
    """One row per window of an item; with known (a bit filter of the items' hashes), of a document: windows of the sizes that items have, if they may be there."""
    wanted = [(name, n, None) for n, exact in sizes for name in (("raw",) if exact else ("code", "alt"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column(1))
            i = 0
            while i < batch.num_rows:  # some texts at once, to bound memory; a text is never cut
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, "right")) - 1)
                words = canonical(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n_words = np.bincount(words["doc"], minlength=j - i)
                found = item_windows(words, j - i) if known is None else _gathered(words, j - i, wanted)
                if known is not None:
                    at = found["hash"] >> _U(64 - FILTER_BITS)
                    hit = (known[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 > 0
                    found = {k: v[hit] for k, v in found.items()}
                ids = batch.column(0).slice(i, j - i).take(pa.array(found["doc"]))
                cuts = list(zip(found["start"].tolist(), (found["start"] + found["size"]).tolist()))
                kinds = [words["code"], words["alt"], words["raw"]]
                codes = [kinds[k][a:b].tobytes() for k, (a, b) in zip(found["codes"].tolist(), cuts)]
                raws = [words["raw"][a:b].tobytes() for a, b in cuts]
                numbers = [pa.array(x.astype(np.int32)) for x in (n_words[found["doc"]], found["at"], found["size"])]
                yield pa.RecordBatch.from_arrays([ids, *numbers, pa.array(found["codes"] == 2), pa.array(found["hash"].view(np.int64)), pa.array(codes, pa.binary()), pa.array(raws, pa.binary())], schema=_rows_arrow)
                i = j

    return run


def _filter_words(hashes: DataFrame) -> np.ndarray:
    """A bit filter of 2**FILTER_BITS bits over the hashes, whatever their number: words of 64 bits come to the driver, 262,144 at most."""
    top = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    packed = hashes.select(F.shiftright(top, 6).alias("w"), top.bitwiseAND(63).cast("int").alias("b")).select("w", F.expr("shiftleft(1L, b)").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    known = np.zeros(1 << (FILTER_BITS - 6), _U)
    for r in packed.toLocalIterator():
        known[r["w"]] = _U(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return known.view(np.uint8)


PAIRS = "doc_id long, item_id long, item_words int, covered_words int, longest_run int, n_slots int, n_changed int"


def _run_lengths(covered: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    """All matched windows of one document and one item, by how far the document's words stand behind the item's.

    At each such offset an item value stands for the document value that it meets
    most often; windows that say otherwise are dropped, and verbatim ones never are."""
    n = int(pdf["item_words"].iloc[0])
    covered, slots, changed = np.zeros(n, bool), 0, 0
    for _, run in pdf.groupby(pdf["d_at"] - pdf["i_at"]):
        found = []
        votes: dict[int, dict[int, int]] = {}
        for i_at, size, codes, d, i in zip(run["i_at"], run["size"], run["codes"], run["d_raws"], run["i_raws"]):
            slot = np.frombuffer(codes, _U) <= 3
            pairs = list(zip(np.frombuffer(i, _U)[slot].tolist(), np.frombuffer(d, _U)[slot].tolist()))
            found.append((i_at, size, d == i, pairs))
            for a, b in pairs:
                votes.setdefault(a, {}).setdefault(b, 0)
                votes[a][b] += 1
        stands = {a: min(v, key=lambda b: (-v[b], b)) for a, v in votes.items()}
        held = set()
        for i_at, size, verbatim, pairs in found:
            if verbatim or all(stands[a] == b for a, b in pairs):
                covered[i_at : i_at + size] = True
                held |= set(pairs)
        slots, changed = max(slots, len(held)), max(changed, sum(a != b for a, b in held))
    return pd.DataFrame([(pdf["doc_id"].iloc[0], pdf["item_id"].iloc[0], n, int(covered.sum()), _run_lengths(covered), slots, changed)], columns=["doc_id", "item_id", "item_words", "covered_words", "longest_run", "n_slots", "n_changed"])


def _idle(min_cover: float, min_run: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """An item's windows with `hot`: common ones, most common first, as long as all that are hot cover too little for a match."""
        pdf = pdf.sort_values(["held", "at", "size", "hash"], ascending=[False, True, True, True])
        n = int(pdf["item_words"].iloc[0])
        covered, hot = np.zeros(n, bool), np.zeros(len(pdf), bool)
        for k, (held, at, size) in enumerate(zip(pdf["held"], pdf["at"], pdf["size"])):
            if held <= COMMON:
                break
            more = covered.copy()
            more[at : at + size] = True
            if more.sum() < min_cover * n and _run_lengths(more) < min_run:
                covered, hot[k] = more, True
        return pdf.assign(hot=hot)[["item_id", "at", "size", "hash", "hot"]]

    return run


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_cover: float = MIN_COVER, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, longest_run, n_slots, n_changed): documents that hold a benchmark item.

    Reported are pairs whose matched windows with agreeing slots cover half of the
    item's words or a run of 20. Of windows that over COMMON items have (the words of a
    task that all its items begin with), an item's most common ones propose no pair
    as long as they together cover less than that: a match has another window then,
    which proposes it, and they count for the pairs so proposed. No match is lost to
    that. SHARED, if set, goes further: no window of more items proposes a pair, but
    the item's rarest ones, so the words of a task alone are no match.

    An item with fewer than 8 words is one window, sought anywhere in the texts; one
    in which no window has four literal words is matched word by word, if it has
    three words. Shorter ones, null texts and empty ones match nothing, and empty
    tables give no rows; very long texts are read whole. Rows without an id are not
    reported. Repeated rows of one id count as one document, equal items each on
    their own. Other columns are not read."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).where("id is not null")
    items = cut(items.mapInArrow(_template_windows(), ROWS))
    known = _filter_words(items)
    sizes = sorted((r["size"], r["exact"]) for r in items.select("size", "exact").distinct().collect())  # 16 at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    if not sizes:
        return rows.where("false").groupBy(F.col("id").alias("doc_id")).applyInPandas(_judge, PAIRS)
    found = rows.mapInArrow(_template_windows(known, sizes), ROWS)
    d = found.select(F.col("id").alias("doc_id"), F.col("at").alias("d_at"), "size", "hash", F.col("raws").alias("d_raws"))
    i = items.select(F.col("id").alias("item_id"), F.col("n_words").alias("item_words"), F.col("at").alias("i_at"), "size", "hash", "codes", F.col("raws").alias("i_raws"))
    most = COMMON if SHARED is None else SHARED
    common = cut(items.groupBy("hash", "size").agg(F.countDistinct("id").alias("held")).where(F.col("held") > most))
    if common.isEmpty():
        pairs = d.join(i, ["hash", "size"])
    else:
        held = i.join(common, ["hash", "size"], "left").withColumn("held", F.coalesce("held", F.lit(1)))
        if SHARED is None:
            each = held.select("item_id", "item_words", F.col("i_at").alias("at"), "size", "hash", "held")
            hot = each.groupBy("item_id").applyInPandas(_idle(min_cover, min_run), "item_id long, at int, size int, hash long, hot boolean")
            hot = hot.where("hot").select("item_id", F.col("at").alias("i_at"), "size", "hash", F.lit(True).alias("hot")).distinct()
            held = cut(held.join(hot, ["item_id", "i_at", "size", "hash"], "left").withColumn("hot", F.coalesce("hot", F.lit(False))).drop("held"))
        else:
            rarest = held.groupBy("item_id").agg(F.min("held").alias("least"))
            held = cut(held.join(rarest, "item_id").withColumn("hot", (F.col("held") > SHARED) & (F.col("held") > F.col("least"))).drop("held", "least"))
        d = cut(d)
        proposed = cut(d.join(held.where("not hot").drop("hot"), ["hash", "size"]))
        confirmed = d.join(common.select("hash", "size"), ["hash", "size"], "left_semi").join(proposed.select("doc_id", "item_id").distinct(), "doc_id")
        confirmed = confirmed.join(held.where("hot").drop("hot"), ["item_id", "hash", "size"])
        pairs = proposed.unionByName(confirmed)
    judged = pairs.groupBy("doc_id", "item_id").applyInPandas(_judge, PAIRS)
    return judged.where((F.col("covered_words") >= min_cover * F.col("item_words")) | (F.col("longest_run") >= min_run))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item. Rows without a doc_id stay, as nothing can name them; of a repeated id all rows go."""
    return without(docs, matches(docs, benchmark).select("doc_id"))
