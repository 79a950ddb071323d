"""Near-duplicate records with small edits.

Order MinHash: a k-mer is a run of words labelled with its occurrence; a sketch takes
the few labelled k-mers of smallest hash and keeps them in the order of the text, so
agreement means similarity under edits. The similarity asked for here is one of sets,
which passages that are pasted again or moved do not change, so further sketches take
first occurrences only, in the order of their hashes; and as minima of tiny sets seldom
agree, short records also meet by an exact prefix filter. Records that agree in any
sketch are candidates. A banded alignment of their words verifies them: what it proves
similar is accepted, and only for the rest the k-mer sets are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.scratch import Scratch

#: Words in a k-mer, k-mers in a sketch, sketches of labelled k-mers in text order, sketches of first occurrences.
WORDS, KEPT, ORDERED, PLAIN = 3, 3, 20, 32
#: Pairs of which one record has at most so many k-mers meet by the exact prefix filter too: three minima of sets that small
#: agree in 10 to 17 % at similarity 0.6, of larger ones in 17 to 22 %, of which 52 sketches lose less than one pair in 10 000.
SHORT = 8
#: A signature has 64 one-bit minima; records of similarity 0.6 agree in 51 bits on average (deviation 3.2; below 39 in 0.013 %), unrelated ones in 32.
SIGNATURE_AGREES = 39
#: A set of keys of up to this many rows is broadcast rather than shuffled.
FEW = 200_000
#: Half the width of the alignment's band, in words.
BAND = 16

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def kmers(words: list[np.ndarray], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-mer, its record), records in order, k-mers in text order."""
    sizes = np.array([len(w) for w in words], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = _mix(np.concatenate(words).astype(np.int64).view(np.uint64))
    owner = np.repeat(np.arange(len(words)), sizes)
    n = max(len(flat) - width + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = _mix(h * _M1 + flat[j : j + n])
    inside = owner[:n] == owner[width - 1 :] if n else np.zeros(0, bool)
    return h[inside], owner[:n][inside]


def occurrences(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which occurrence of its record's k-mer each one is, from 0, in text order."""
    both = _mix(h + (owner.astype(np.uint64) + np.uint64(1)) * _M3)
    ordered = np.sort(both)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    label = np.zeros(len(h), np.int64)
    if not len(twice):
        return label
    # only k-mers that a record repeats need a look
    at = np.nonzero(np.isin(both, twice))[0]
    order = at[np.lexsort((at, h[at], owner[at]))]
    s, o = h[order], owner[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (o[1:] != o[:-1])]
    n = np.arange(len(order))
    label[order] = n - np.maximum.accumulate(np.where(new, n, 0))
    return label


def _mix_in(x: np.ndarray, spare: np.ndarray) -> None:
    """``_mix`` in place."""
    for shift, factor in ((30, _M2), (27, _M3), (31, None)):
        np.right_shift(x, np.uint64(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor is not None:
            np.multiply(x, factor, out=x)


#: K-mers hashed at a time in ``sketch``: what fits a processor's cache.
_AREA = 60_000


def sketch(h: np.ndarray, owner: np.ndarray, records: int, kept: int = KEPT, ordered: int = ORDERED, plain: int = PLAIN, signature: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sketch value, record): ``ordered`` and then ``plain`` sketches of each record with at least one k-mer.

    Ordered sketches take labelled k-mers in text order, plain ones first occurrences
    in the order of their hashes. ``signature`` gets 64 bits a record, one of the
    smallest hash of the first occurrences in each of 64 rounds.
    """
    label = occurrences(h, owner)
    again = label > 0
    h = np.where(again, _mix(h + label.astype(np.uint64) * _M2), h) if again.any() else h
    size = np.bincount(owner, minlength=records)
    start = np.cumsum(size) - size
    values, who = [], []
    by_size = np.argsort(size, kind="stable")
    by_size = by_size[size[by_size] > 0]
    rounds = ordered + plain
    last = rounds if signature is None else max(rounds, 64)
    seeds = _mix(np.uint64(1000003) + np.arange(last, dtype=np.uint64))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    at = 0
    while at < len(by_size):
        # records of like size share a padded matrix of bounded area
        widest = int(size[by_size[at]] * 1.2) + 4
        end = at + int(np.searchsorted(size[by_size[at:]], widest, side="right"))
        end = min(end, at + max(1, _AREA // widest))
        rec = by_size[at:end]
        wide = int(size[rec[-1]])
        pos = np.minimum(start[rec][:, None] + np.arange(wide), len(h) - 1)
        beyond = np.arange(wide) >= size[rec][:, None]
        pad = np.where(beyond, top, np.uint64(0))
        repeated = again[pos] & ~beyond
        pad_first = np.where(repeated, top, pad) if repeated.any() else pad
        grid = h[pos]
        row = np.arange(len(rec))
        v, spare = np.empty_like(grid), np.empty_like(grid)
        for j in range(last):
            np.bitwise_xor(grid, seeds[j], out=v)
            _mix_in(v, spare)
            first = v | pad_first if j < ordered and pad_first is not pad else None
            np.bitwise_or(v, pad if j < ordered else pad_first, out=v)
            least = v.argmin(1)
            if signature is not None and j < 64:
                one = least if first is None else first.argmin(1)
                signature[rec] |= (_mix(grid[row, one] ^ seeds[j]) & np.uint64(1)) << np.uint64(j)  # a fresh bit a round
            if j >= rounds:
                continue
            low = np.full((len(rec), kept), wide, np.int64)  # ``wide``: the record has no more k-mers
            low[:, 0] = least
            for c in range(1, kept):
                v[row, low[:, c - 1] % wide] = top
                nxt = v.argmin(1)
                low[:, c] = np.where(v[row, nxt] == top, wide, nxt)
            if j < ordered:
                low.sort(axis=1)
            s = np.full(len(rec), 7919 + j, np.uint64)
            for c in range(kept):
                part = low[:, c]
                s = np.where(part < wide, _mix(s * _M1 + grid[row, part % wide]), s)
            values.append(s)
            who.append(rec)
        at = end
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(values), np.concatenate(who)


def prefixes(h: np.ndarray, owner: np.ndarray, records: int, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(sketch value, record): the prefix filter over first occurrences of records with at most ``most`` k-mers.

    Of n k-mers in one order for all records, n - ceil(least * n) + 1 come first; sets
    of at least that similarity share one of them, so none is missed.
    """
    first = occurrences(h, owner) == 0
    h, owner = h[first], owner[first]
    n = np.bincount(owner, minlength=records)
    small = n[owner] <= most
    h, owner = h[small], owner[small]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    start = np.cumsum(np.bincount(owner, minlength=records)) - np.bincount(owner, minlength=records)
    keep = np.arange(len(h)) - start[owner] < (n - np.ceil(least * n - 1e-9) + 1)[owner]
    return _mix(h[keep] + np.uint64(104729)), owner[keep]


def edit_distance(a: list[np.ndarray], b: list[np.ndarray], band: int = BAND) -> np.ndarray:
    """Banded edit distance of each pair of sequences, all pairs at once; an upper bound if the best path leaves the band."""
    n = len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if not n:
        return np.zeros(0, np.int64)
    wa, wb = int(la.max()), int(lb.max())
    big = np.int32(1 << 28)
    width = 2 * band + 1
    A = np.zeros((n, wa), np.int64)
    # positions outside a sequence never match: the band reads B with a margin
    B = np.zeros((n, wb + 2 * width + wa), np.int64)
    in_b = np.zeros(B.shape, bool)
    for i, (x, y) in enumerate(zip(a, b)):
        A[i, : len(x)] = x
        B[i, band : band + len(y)] = y
        in_b[i, band : band + len(y)] = True
    k = np.arange(width, dtype=np.int32)
    # row 0: column j = k - band costs j insertions
    row = np.where(k >= band, k - band, big)[None, :].repeat(n, 0).astype(np.int32)
    out = np.full(n, big, np.int32)

    def note(i: int, row: np.ndarray) -> None:
        done = np.nonzero(la == i)[0]
        at = lb[done] - i + band
        ok = (at >= 0) & (at < width)
        out[done[ok]] = row[done[ok], at[ok]]

    note(0, row)
    for i in range(1, wa + 1):
        # column j of row i lies at k = j - i + band; B carries a margin of `band`
        lo = i - 1
        same = (B[:, lo : lo + width] == A[:, i - 1 : i]) & in_b[:, lo : lo + width]
        step = row + np.where(same, 0, 1).astype(np.int32)  # from (i-1, j-1)
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)  # from (i-1, j)
        j = k - band + i
        step[:, j < 0] = big
        if i <= band:
            step[:, band - i] = i  # column 0
        row = (np.minimum.accumulate(step - k, axis=1) + k).astype(np.int32)  # from (i, j-1)
        row = np.minimum(row, big)
        note(i, row)
    # a length difference above the band has no path inside it
    return np.where(out >= big, np.maximum(la, lb), out).astype(np.int64)


def common(h: np.ndarray, owner: np.ndarray, g: np.ndarray, other: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-mers on the left, on the right and in both, for each of n pairs."""

    def distinct(x: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((x, o))
        x, o = x[order], o[order]
        keep = np.r_[True, (x[1:] != x[:-1]) | (o[1:] != o[:-1])] if len(x) else np.zeros(0, bool)
        return x[keep], o[keep]

    x, o = distinct(h, owner)
    y, p = distinct(g, other)
    z, q = np.r_[x, y], np.r_[o, p]
    order = np.lexsort((z, q))
    z, q = z[order], q[order]
    twice = (z[1:] == z[:-1]) & (q[1:] == q[:-1])
    return np.bincount(o, minlength=n), np.bincount(p, minlength=n), np.bincount(q[1:][twice], minlength=n)


def verify(a: list[np.ndarray], b: list[np.ndarray], na: np.ndarray, nb: np.ndarray, least: float, width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(accepted, edit similarity, proven by the alignment) of each pair of word sequences with ``na`` and ``nb`` distinct k-mers.

    An edit takes away at most ``width`` distinct k-mers of either side, so a small
    enough distance proves the similarity; the sets are compared for all others.
    """
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    dist = np.maximum(la, lb)
    inside = np.nonzero(np.abs(la - lb) <= BAND)[0]  # else no path stays in the band
    dist[inside] = edit_distance([a[i] for i in inside], [b[i] for i in inside])
    sure = np.maximum(np.maximum(na, nb) - width * dist, 0)
    proven = (sure > 0) & (sure >= least * (na + nb - sure))
    ok = proven.copy()
    rest = np.nonzero(~proven)[0]
    if len(rest):
        (h, o), (g, p) = kmers([a[i] for i in rest], width), kmers([b[i] for i in rest], width)
        ra, rb, both = common(h, o, g, p, len(rest))
        ok[rest] = (both > 0) & (both >= least * (ra + rb - both))
    return ok, 1 - dist / np.maximum(np.maximum(la, lb), 1), proven


def word_hashes(text: Column) -> Column:
    """Hashes of the words (runs of a-z and 0-9 in lower case), in order."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.xxhash64(w))


class NearDuplicates:
    """Near-duplicates of ``df``: records ``key`` with ``text``.

    ``members``: (class_key, key), records with the same text but for case share a
    class. ``pairs``: (class_a, class_b, edit_similarity, proven), similar classes,
    class_a < class_b; ``proven`` tells whether the alignment settled the pair.

    ``exact``: candidates come from the prefix filter for records of every size and no
    signature drops any, so no pair is missed; it costs two fifths of a record's
    k-mers in rows at 0.6, and more chance candidates.

    Defined cases: a null text is empty; a record with fewer words than a k-mer is
    similar to nothing; repeated rows count once; null keys are left out. Words are
    compared by 64-bit hashes. Only one record of each class is sketched, so copies
    do not multiply candidates.
    """

    def __init__(self, df: DataFrame, key: str, text: Column, least: float = 0.6, width: int = WORDS, kept: int = KEPT, ordered: int = ORDERED, plain: int = PLAIN, agrees: int = SIGNATURE_AGREES, exact: bool = False):
        s = self.scratch = Scratch(df.sparkSession, "neardup")
        raw = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
        # copies are found by two hashes of the text in lower case; the smallest key stands for its class
        marks = s.save(raw.select("key", F.xxhash64(F.lower("text")).alias("h1"), F.hash(F.lower("text")).alias("h2")).distinct())
        reps = marks.groupBy("h1", "h2").agg(F.min("key").alias("class_key"))
        self.members = s.save(marks.join(reps, ["h1", "h2"]).select("class_key", "key"))
        extra = self.members.filter("key <> class_key").select("key")
        # classes of copies with words enough to be similar at all: one text a class is read
        twice = extra.join(self.members, "key").select(F.col("class_key").alias("key")).distinct()
        told = raw.join(F.broadcast(twice) if twice.count() <= FEW else twice, "key", "left_semi")
        self.copied = s.save(told.filter(F.size(word_hashes(F.col("text"))) >= width).select(F.col("key").alias("class_key")).distinct())
        single = raw.join(F.broadcast(extra) if extra.count() <= FEW else extra, "key", "left_anti")
        words = single.select("key", word_hashes(F.col("text")).alias("words")).filter(F.size("words") >= width)

        agrees = 0 if exact else agrees

        def sketched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                p = p.drop_duplicates("key")
                w = [np.asarray(x, np.int64) for x in p["words"]]
                keys = p["key"].to_numpy()
                h, owner = kmers(w, width)
                sig = np.zeros(len(w), np.uint64)
                v, who = prefixes(h, owner, len(w), least, math.inf if exact else SHORT / least)
                if not exact:
                    v1, who1 = sketch(h, owner, len(w), kept, ordered, plain, sig)
                    v, who = np.r_[v, v1], np.r_[who, who1]
                yield pd.DataFrame({"sketch": v.view(np.int64), "key": keys[who], "sig": sig[who].view(np.int64)})

        # one exchange serves both sides; being the planner's own, adaptive execution splits the partitions of hot sketches
        rows = words.mapInPandas(sketched, "sketch long, key long, sig long")
        a = rows.select("sketch", F.col("key").alias("class_a"), F.col("sig").alias("sa"))
        b = rows.select("sketch", F.col("key").alias("class_b"), F.col("sig").alias("sb"))
        met = a.join(b.hint("merge"), "sketch").filter("class_a < class_b")
        if agrees:
            met = met.filter(64 - F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) >= agrees)
        met = met.select("class_a", "class_b").distinct()
        self.candidates = s.save(met)

        asked = self.candidates.select(F.explode(F.array("class_a", "class_b")).alias("key")).distinct()
        asked = s.save(asked)
        # words are hashed again only for the candidates
        texts = single.join(F.broadcast(asked) if asked.count() <= FEW else asked, "key", "left_semi").dropDuplicates(["key"])
        at = F.sequence(F.lit(1), F.size("words") - (width - 1))
        count = F.size(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice("words", i, width)))))
        texts = s.save(texts.select("key", word_hashes(F.col("text")).alias("words")).select("key", "words", count.alias("n")))
        both = self.candidates.join(texts.select(F.col("key").alias("class_a"), F.col("words").alias("wa"), F.col("n").alias("na")), "class_a")
        both = both.join(texts.select(F.col("key").alias("class_b"), F.col("words").alias("wb"), F.col("n").alias("nb")), "class_b")

        def verified(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                p = p.iloc[np.argsort(p["wa"].map(len).to_numpy(), kind="stable")]
                size = p["wa"].map(len).to_numpy() + p["wb"].map(len).to_numpy() + 64
                # batches of a bounded number of words
                batch = np.cumsum(size) // 400_000
                for _, part in p.groupby(batch, sort=False):
                    wa, wb = ([np.asarray(x, np.int64) for x in part[c]] for c in ("wa", "wb"))
                    ok, edit, proven = verify(wa, wb, part["na"].to_numpy(), part["nb"].to_numpy(), least, width)
                    yield pd.DataFrame({"class_a": part["class_a"].to_numpy()[ok], "class_b": part["class_b"].to_numpy()[ok], "edit_similarity": edit[ok], "proven": proven[ok]})

        self.pairs = s.save(both.select("class_a", "class_b", "wa", "wb", "na", "nb").mapInPandas(verified, "class_a long, class_b long, edit_similarity double, proven boolean"))

    def record_pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: all similar records, copies among themselves too."""
        a = self.members.select(F.col("class_key").alias("class_a"), F.col("key").alias("x"))
        b = self.members.select(F.col("class_key").alias("class_b"), F.col("key").alias("y"))
        across = self.pairs.join(a, "class_a").join(b, "class_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        same = a.join(self.copied.withColumnRenamed("class_key", "class_a"), "class_a", "left_semi")
        within = same.join(b.withColumnRenamed("class_b", "class_a"), "class_a").filter("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
        return across.unionByName(within)

    def class_links(self) -> DataFrame:
        """(key, class_key, copies, links): each record of a similar pair or a class of copies.

        ``copies`` are the other records of its class, ``links`` the similar classes.
        """
        sizes = self.members.groupBy("class_key").agg(F.count(F.lit(1)).alias("n"))
        ends = self.pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_key")).groupBy("class_key").agg(F.count(F.lit(1)).alias("links"))
        alike = self.copied.select("class_key", F.lit(True).alias("copied"))
        known = sizes.join(ends, "class_key", "left").join(alike, "class_key", "left").na.fill(0, ["links"]).filter("copied OR links > 0")
        return self.members.join(known, "class_key").select("key", "class_key", (F.col("n") - 1).alias("copies"), "links")
