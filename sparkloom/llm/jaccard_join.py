"""N-gram Jaccard join by parity sketches.

Every distinct word shingle of a document toggles one part of its sketch: the part is chosen by the
shingle's hash and holds the XOR of the hashes that fell into it. Documents that differ in d shingles
differ in at most d parts, so the number of differing parts is a lower bound of the symmetric difference.
J(A, B) >= 3/4 means |A ^ B| <= (|A| + |B|) / 7. Within a band of sizes this bounds d by D, and whichever
document has more than D parts in use shares at least one part, in use, with each document it links to.
Documents are joined on (band, part, value of the part), and the pairs are verified on whole shingle sets.

Lossless by construction:

* sizes: a pair is looked for in the band of its smaller set; a document takes part in its own band and in
  those lower ones whose sets it can link to.
* rare shingles: a first sketch is made of the rare ones (any choice of these is right). A document with more than D parts in use
  joins the first D + 1: of two documents, take the one whose first D + 1 end earlier; one of these is the same in the other, and among its first. A document
  with at most D joins all, and each of its rare shingles by itself. A pair that has met nowhere so far shares no rare shingle.
* frequent shingles: such a pair differs in all rare shingles of both, so with r of them, only D - r differences are left to a document's
  frequent ones. These are sketched with other seeds and joined likewise; a document with no more parts in use than that goes on to a
  second seed, and then to single shingles.
* groups that share a part: first each member is compared with one of them. Pairs within one component need no more, so a group of near copies costs one
  comparison for each member. In what still spans components, all members are compared where they share rare shingles (few do). Where they share
  frequent ones, each is compared only with the document that has the fewest rare shingles among all with the same frequent set, its base. That is enough: if A and B
  link and share no rare shingle, then A links with B's base, B with A's, and the two bases link, since a base has no more rare shingles to differ in. So a passage that very many texts
  share costs one comparison for each text and base, not for each pair.
  A comparison first looks at bit sketches of whole sets, in which each shingle toggles one bit: if they differ in more places than
  the two sets may, the pair goes. Blocks of sketches are compared at once, and only pairs that pass become rows.
* keys that very many documents have: a task that holds HOT members of a key keeps them as a group around one of them, and sends on only that one; the groups of
  one key bear one name. So a task gets at most a few members of a key from each other task.

Null or empty texts and texts without words have an empty set and link with nothing. Texts with fewer words
than the shingle length have their whole word sequence as the only shingle. Equal sets form one class before
anything is joined. Rows with the same doc_id are told apart by a hash of their text; rows equal in both
come out once for each row, alike. An empty table gives an empty result. Very long texts are cut into words whole; a text's shingles are held in one task's
memory, eight bytes each. Further columns of the input are ignored. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared
from ._words import SPACES, Words, mix, scratch, slices, trim

#: Shingles of so many classes among COUNTED of a task's are counted over all tasks; from FREQUENT on they count as frequent, the MOST_FREQUENT most
#: frequent at most (four bytes each are broadcast). The result is the same whichever count as frequent; only the sizes of groups change.
FREQUENT_IN_TASK, COUNTED = 2, 2_000_000
FREQUENT = 12
MOST_FREQUENT = 2_000_000
#: Keys for one task of the part join, and keys that a task holds before it sends them on.
KEYS_PER_TASK = 450_000
HELD = 400_000
#: Members of a key among those HELD from which they form a group of their own.
HOT = 64
#: Members of a block, where a group that spans components is compared in blocks.
BLOCK = 512

_U = np.uint64


class Bands:
    """Bands of set sizes for the similarity 3/4: [low[k], low[k + 1])."""

    def __init__(self, ratio: float = 1.6):
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(low[-1] * ratio)))
        self.low = low
        #: Parts of a sketch: more than the largest D of the band, with room for parts that stay empty.
        self.parts = [5 * ((b - 1 + (b - 1) * 4 // 3) // 7 + 1) // 4 + 6 for b in low[1:]]

    def of(self, n: int) -> list[tuple[int, int]]:
        """Bands that a set of n takes part in, each with its D."""
        k = int(np.searchsorted(self.low, n, side="right")) - 1
        out = [(k, (n + n * 4 // 3) // 7)]
        while k and self.low[k] - 1 >= -(-3 * n // 4):
            k -= 1
            out.append((k, (n + self.low[k + 1] - 1) // 7))
        return out


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each text."""
    for at, to in slices(texts):
        w = Words(texts.slice(at, to - at), SPACES)
        with np.errstate(over="ignore"):
            grams = w.grams(k)
        for i in range(w.n):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= k:
                g = np.sort(grams[a : b - k + 1])
                yield at + i, g[np.concatenate(([True], g[1:] != g[:-1]))]
            elif b > a:
                h = _U(b - a)
                with np.errstate(over="ignore"):
                    for x in w.hashes[a:b]:
                        h = mix(np.array([h * _U(0xD6E8FEB86659FD93) + x]))[0]
                yield at + i, np.array([h], dtype=_U)
            else:
                yield at + i, np.zeros(0, dtype=_U)


def class_of(s: np.ndarray) -> int:
    """One id for equal sets: 0 for the empty set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        m = mix(s, 0x1234567)
        both = mix(np.array([m.sum(), np.bitwise_xor.reduce(mix(s, 0x7654321))], dtype=_U), len(s))
        return int(mix(both[:1] * _U(3) + both[1:])[0].astype(np.int64))


PROFILE = ["kind", "doc_id", "text_hash", "n", "class", "sketch"]


def _profile(k: int):
    """Rows of kind 0 (doc_id, text_hash, n, class, and the sketch with the first of a class) and of kind 1 (shingle, number of classes in this task)."""

    def run(batches):
        scratch("jaccard")
        seen: set[int] = set()
        many: list[np.ndarray] = []
        held = 0

        def counted():
            """Those of the shingles held that several classes have."""
            nonlocal many, held
            token = np.concatenate(many)
            many, held = [], 0
            token.sort()
            first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            count = np.diff(np.append(first, len(token)))
            keep = count >= FREQUENT_IN_TASK
            token, count = token[first[keep]].view(np.int64), count[keep]
            none = pa.nulls(len(token), pa.int64())
            trim()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(token), np.int8)), none, none, pa.array(count), pa.array(token), pa.nulls(len(token), pa.binary())], PROFILE
            )

        for batch in batches:
            ids, hashes, texts = (batch.column(i) for i in range(3))
            n, cls, bits = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), [None] * len(ids)
            for i, s in shingle_sets(texts, k):
                n[i], cls[i] = len(s), (c := class_of(s))
                if len(s) and c not in seen:
                    seen.add(c)
                    bits[i] = sketch(s)
                    many.append(s)
                    held += len(s)
            if len(seen) > 2_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(ids), np.int8)), ids, hashes, pa.array(n), pa.array(cls), pa.array(bits, pa.binary())], PROFILE
            )
            if held > COUNTED:
                yield counted()
        if held:
            yield counted()
        trim()

    return run


def _first_parts(use: np.ndarray, seed: int, m: int, most: int) -> tuple[np.ndarray, int]:
    """(keys of the first most + 1 parts in use, parts in use) of a sketch of m parts."""
    if not len(use):
        return np.zeros(0, _U), 0
    h = mix(use, 0xABCD + 0x1111 * seed)
    part = (h >> _U(20)) % _U(m)
    order = np.argsort(part)
    part = part[order]
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    xor = np.bitwise_xor.reduceat(h[order], first)[: most + 1]
    return xor + part[first[: most + 1]] * _U(0x9E3779B97F4A7C15), len(first)


def part_keys(s: np.ndarray, rare: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys of one set; rare marks its rare shingles. The last bit is 1 for keys made of frequent shingles."""
    out = []
    few, many = s[rare], s[~rare]
    with np.errstate(over="ignore"):

        def add(keys, salt, frequent):
            out.append(mix(keys, salt) & ~_U(1) | _U(frequent))

        for band, most in bands.of(len(s)):
            m = bands.parts[band]
            keys, used = _first_parts(few, 0, m, most)
            add(keys, 0xF00D + 64 * band, 0)
            if used > most:
                continue
            add(few, 0x3779 + 977 * band, 0)
            left = most - len(few)  # differences that a partner without a common rare shingle may have in frequent ones
            if left < 0:
                continue
            for seed in (1, 2):
                keys, used = _first_parts(many, seed, m, left)
                add(keys, 0xF00D + 64 * band + seed, 1)
                if used > left:
                    break
            else:
                add(many, 0x7933 + 977 * band, 1)
    return np.concatenate(out) if out else np.zeros(0, _U)


def _short(key: np.ndarray, tasks: int) -> np.ndarray:
    """30 bits of a key within its task, and its last bit; the lowest bit is free."""
    return ((key // _U(tasks)) & _U(0x7FFFFFFE)) << _U(1) | (key & _U(1)) << _U(1)


def _name(task: np.ndarray, short: np.ndarray) -> np.ndarray:
    """The name of a key's group; the last bit says whether it is made of frequent shingles."""
    return mix((task.astype(_U) << _U(32)) + (short & ~_U(1)), 0x6B) & ~_U(1) | (short >> _U(1)) & _U(1)


KEYS = ["task", "what", "keys", "at", "classes", "short"]


def _keys(k: int, frequent, tasks: int, bands: Bands):
    """Packed rows for target tasks. what 0: keys, index into classes, classes. what 1: groups of hot keys (name, member of the middle, class). what 2:
    (frequent set, number of rare shingles, class) of documents with keys made of frequent shingles."""

    def run(batches):
        scratch("jaccard")
        common = np.frombuffer(frequent.value, dtype=np.uint32)
        seen: set[int] = set()
        keys, classes, counts, bases, held = [], [], [], [], 0

        def flush():
            nonlocal keys, classes, counts, bases, held
            if not held:
                return
            key, ids = np.concatenate(keys), np.array(classes, dtype=np.int64)
            index = np.repeat(np.arange(len(ids)), counts)
            to = key % _U(tasks)
            short = _short(key, tasks)
            order = np.lexsort((ids[index], short, to))
            short, index, to = short[order], index[order], to[order]
            rows = []
            if len(key):
                fresh = np.concatenate(([True], (short[1:] != short[:-1]) | (to[1:] != to[:-1])))
                first = np.flatnonzero(fresh)
                size = np.diff(np.append(first, len(short)))
                hot = size >= HOT
                if hot.any():
                    inside = np.repeat(hot, size)
                    name = _name(to[inside], short[inside])
                    middle = ids[index[np.repeat(first[hot], size[hot])]]
                    rows.append((int(to[first[hot][0]]), 1, name.tobytes(), middle.tobytes(), ids[index[inside]].tobytes(), False))
                    short[first[hot]] |= _U(1)
                    stay = ~inside
                    stay[first[hot]] = True
                    short, index, to = short[stay], index[stay], to[stay]
            cut = np.searchsorted(to, np.arange(tasks + 1, dtype=_U))
            for t in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[t], cut[t + 1]
                own, at = np.unique(index[a:b], return_inverse=True)
                few = len(own) < 65536
                rows.append((t, 0, short[a:b].astype(np.uint32).tobytes(), at.astype(np.uint16 if few else np.uint32).tobytes(), ids[own].tobytes(), few))
            if bases:
                base, rare, cls = (np.array(x, dtype=np.int64) for x in zip(*bases, strict=True))
                rows.append((int(cls[0] % tasks), 2, base.tobytes(), rare.tobytes(), cls.tobytes(), False))
            keys, classes, counts, bases, held = [], [], [], [], 0
            trim()
            kinds = (pa.int32(), pa.int8(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], KEYS)

        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                seen.add(c)
                if len(common):
                    high = (s >> _U(32)).astype(np.uint32)
                    rare = common[np.minimum(np.searchsorted(common, high), len(common) - 1)] != high
                else:
                    rare = np.ones(len(s), dtype=bool)
                own = part_keys(s, rare, bands)
                keys.append(own)
                classes.append(c)
                counts.append(len(own))
                held += len(own)
                if (own & _U(1)).any():
                    bases.append((class_of(s[~rare]), int(rare.sum()), c))
                if held > HELD:
                    yield from flush()
            if len(seen) > 2_000_000:
                seen.clear()
        yield from flush()
        trim()

    return run


GROUPS = ["what", "group", "class", "rep"]


def _groups(batches):
    """(what, group, class, rep): what 0 for the members of groups of at least two classes that share a key, equal groups once, each with one of them;
    what 2 for (frequent set, class, number of rare shingles)."""
    scratch("jaccard")
    key, cls, task = [], [], 0

    def rows(what, group, cls, rep):
        for at in range(0, len(cls), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cls[part]), what, np.int8)), *(pa.array(x[part].view(np.int64)) for x in (group, cls, rep))], GROUPS)

    for batch in batches:
        for i in range(batch.num_rows):
            what = batch.column(1)[i].as_py()
            k, at, ids = (batch.column(c)[i].as_buffer() for c in (2, 3, 4))
            ids = np.frombuffer(ids, dtype=np.int64)
            if what:
                a, b = np.frombuffer(k, dtype=np.int64), np.frombuffer(at, dtype=np.int64)
                yield from rows(2, a, ids, b) if what == 2 else rows(0, a, ids, b)
                continue
            own = np.frombuffer(k, dtype=np.uint32)
            key.append((own.astype(_U), np.full(len(own), batch.column(0)[i].as_py(), _U)))
            cls.append(ids[np.frombuffer(at, dtype=np.uint16 if batch.column(5)[i].as_py() else np.uint32)])
    if not key:
        return
    key, task, cls = np.concatenate([x[0] for x in key]), np.concatenate([x[1] for x in key]), np.concatenate(cls)
    hot, key = (key & _U(1)).astype(bool), key & ~_U(1) | task << _U(32)
    trim()
    order = np.argsort(key)
    key, cls, hot = key[order], cls[order], hot[order]
    same = key[1:] == key[:-1]
    keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
    key, cls, hot = key[keep], cls[keep], hot[keep]
    order = np.lexsort((~hot, cls, key))
    key, cls, hot = key[order], cls[order], hot[order]
    if not len(key):
        return
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])))
    key, cls, hot = key[fresh], cls[fresh], hot[fresh]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    with np.errstate(over="ignore"):
        mark = mix(np.add.reduceat(mix(cls.view(_U)), first) + size.astype(_U)) & ~_U(1) | (key[first] >> _U(1)) & _U(1)
        any_hot = np.logical_or.reduceat(hot, first)
        mark = np.where(any_hot, _name(key[first] >> _U(32), key[first] & _U(0xFFFFFFFF)), mark)
    _, one = np.unique(mark, return_index=True)
    one = one[(size[one] > 1) | any_hot[one]]
    size, first = size[one], first[one]
    place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    yield from rows(0, np.repeat(mark[one], size), cls[place], np.repeat(cls[first], size))


def sketch(s: np.ndarray) -> bytes:
    """Parity bits of a set: each element toggles one of 2 to 4 bits for each element. The upper half folds onto the lower one."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    with np.errstate(over="ignore"):
        at = mix(s, 0x51E7) & _U(bits - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def fold(a: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) brought down to so many words."""
    while a.shape[1] > words:
        half = a.shape[1] // 2
        a = a[:, :half] ^ a[:, half:]
    return a


def _sets(k: int):
    def run(batches):
        for batch in batches:
            cls, blob, held = [], [], 0
            ids = batch.column(0).to_pylist()

            def out():
                return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(blob, pa.binary())], ["class", "shingles"])

            for i, s in shingle_sets(batch.column(1), k):
                cls.append(ids[i])
                blob.append(s.tobytes())
                held += s.nbytes
                if held > 4 << 20:
                    yield out()
                    cls, blob, held = [], [], 0
            yield out()
        trim()

    return run


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union for sorted distinct arrays."""
    n, m = len(a), len(b)
    if 4 * min(n, m) < 3 * max(n, m):
        return False
    at = np.minimum(np.searchsorted(b, a), m - 1)
    common = int((b[at] == a).sum())
    return 100 * common >= 75 * (n + m - common)


def _verify(batches):
    for batch in batches:
        u, v, a, b = (batch.column(i) for i in range(4))
        keep = [linked(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)) for x, y in zip(a, b, strict=True)]
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], ["u", "v"])


def _near(batches):
    """Of pairs (u, v, n, sketch, n, sketch), those whose sketches differ in no more places than their sets may."""
    for batch in batches:
        u, v, n, a, m, b = batch.columns
        n, m = n.to_numpy(), m.to_numpy()
        keep = 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)
        for i in np.flatnonzero(keep):
            x, y = (np.frombuffer(c[int(i)].as_buffer(), _U)[None] for c in (a, b))
            words = min(x.shape[1], y.shape[1])
            keep[i] = np.bitwise_count(fold(x, words) ^ fold(y, words)).sum() <= (n[i] + m[i]) // 7
        keep = pa.array(keep)
        yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], ["u", "v"])


def _sides(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """(u, v, s): for each of the distinct pairs, the two structs of columns. Only the rows of the pairs move, to the pair's task."""
    sides = pairs.select("u", "v", F.explode(F.array("u", "v")).alias("class"))
    both = sets.select("class", F.struct(*columns).alias("side")).join(sides, "class").groupBy("u", "v").agg(F.collect_list("side").alias("s"))
    return both.where(F.size("s") == 2)


def _similar(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of the distinct pairs (u, v) that may link by their sketches."""
    s = F.col("s")
    both = _sides(pairs, sketches, ["n", "sketch"])
    return both.select("u", "v", s[0]["n"].alias("n"), s[0]["sketch"].alias("a"), s[1]["n"].alias("m"), s[1]["sketch"].alias("b")).mapInArrow(_near, "u long, v long")


def _verified(pairs: DataFrame, base: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Those of the written, distinct pairs (u, v) that link, by the whole shingle sets of their documents."""
    some = pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct()
    first = rows.where("n > 0").groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("d"))
    needed = first.join(some, "class").select(F.xxhash64("d.doc_id", "d.text_hash").alias("key"), "class", F.col("d.doc_id").alias("d"), F.col("d.text_hash").alias("h"))
    needed = _shared.written(needed, "needed")
    key = F.xxhash64("doc_id", "text_hash")
    texts = _shared.among(base, key, needed).withColumn("key", key).join(needed, "key").where("doc_id <=> d and text_hash = h").select("class", "text")
    sets = _shared.written(texts.mapInArrow(_sets(k), "class long, shingles binary"), "sets")
    if sets.count() > needed.count():  # repeated rows
        sets = _shared.written(sets.dropDuplicates(["class"]), "sets")
    s = F.col("s")
    both = _sides(pairs, sets, ["shingles"])
    out = _shared.written(both.select("u", "v", s[0]["shingles"].alias("a"), s[1]["shingles"].alias("b")).mapInArrow(_verify, "u long, v long"), "edges")
    _shared.drop(sets, needed)
    return out


def _across(batches):
    """Pairs of members of two blocks that are not in one component and whose sizes and sketches allow a link."""
    for batch in batches:
        for i in range(batch.num_rows):
            sides = []
            for c in (0, 1):
                v = batch.column(c)[i].values
                cls, part, n = (v.field(f).to_numpy() for f in ("class", "component", "n"))
                sides.append((cls, part, n, [np.frombuffer(x.as_buffer(), _U) for x in v.field("sketch")]))
            (x, cx, nx, sx), (y, cy, ny, sy) = sides
            size_x, size_y = np.array([len(s) for s in sx]), np.array([len(s) for s in sy])
            found = []
            for wx in np.unique(size_x):
                for wy in np.unique(size_y):
                    if max(wx, wy) > 4 * min(wx, wy):
                        continue  # sizes are too far apart
                    p, q = np.flatnonzero(size_x == wx), np.flatnonzero(size_y == wy)
                    words = int(min(wx, wy))
                    a, b = fold(np.stack([sx[j] for j in p]), words), fold(np.stack([sy[j] for j in q]), words)
                    low, high = np.minimum(nx[p][:, None], ny[q][None, :]), np.maximum(nx[p][:, None], ny[q][None, :])
                    r, c = np.nonzero((4 * low >= 3 * high) & (cx[p][:, None] != cy[q][None, :]))
                    most = (nx[p][r] + ny[q][c]) // 7
                    off = np.zeros(len(r), dtype=np.int64)
                    for w in range(0, words, 4):
                        off += np.bitwise_count(a[r, w : w + 4] ^ b[c, w : w + 4]).sum(axis=1, dtype=np.int64)
                        stay = off <= most
                        r, c, most, off = r[stay], c[stay], most[stay], off[stay]
                    found.append(np.stack((np.minimum(x[p][r], y[q][c]), np.maximum(x[p][r], y[q][c]))))
            if found:
                u, v = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _spanning(groups: DataFrame, parts: DataFrame, sketches: DataFrame, bases: DataFrame) -> DataFrame:
    """Pairs (u, v) across components, from groups of three or more that span components, that may link by their sketches. Groups around one component are put together."""
    member = groups.join(parts, groups["class"] == parts["node"], "left").select("group", "class", F.coalesce("component", "class").alias("component"))
    member = _shared.written(member, "member")
    span = member.groupBy("group").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi and size > 2")
    span = _shared.written(span.select(F.col("group").alias("g"), "lo"), "span")
    open_ = member.join(span, F.col("group") == F.col("g")).select("lo", (F.col("group") % 2 != 0).alias("frequent"), "class", "component").distinct()
    open_ = _shared.written(open_.join(bases, "class", "left").select("lo", "frequent", "class", "component", (~F.col("frequent") | F.col("base")).alias("base")), "open")
    size = open_.groupBy("lo", "frequent").agg(F.count("*").alias("size"), F.count_if("base").alias("bases"))
    # blocks by class; those of bases alone are cut apart, so a block never holds more than about BLOCK of either
    whole = open_.join(size, ["lo", "frequent"]).join(sketches, "class")
    block = lambda n: F.expr(f"int(pmod(xxhash64(class), ceil({n} / {BLOCK})))")
    members = F.collect_list(F.struct("class", "component", "n", "sketch")).alias("members")
    left = _shared.written(whole.groupBy("lo", "frequent", block("size").alias("block")).agg(members), "blocks")
    right = _shared.written(whole.where("base").groupBy("lo", "frequent", block("bases").alias("block2")).agg(members.alias("members2")), "blocks")
    both = left.join(right, ["lo", "frequent"]).where("frequent or block <= block2").select("members", "members2")
    out = _shared.written(both.mapInArrow(_across, "u long, v long").where("u <> v").distinct(), "pairs")
    _shared.drop(member, span, open_, left, right)
    return out


def jaccard_components(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id) for each row of docs; component_id is the smallest doc_id
    reachable by links of Jaccard similarity 3/4 or more between sets of k-word shingles, itself included; component
    is a number of the component's own, null for empty sets."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    found = _shared.written(base.mapInArrow(_profile(k), "kind byte, doc_id long, text_hash long, n long, class long, sketch binary"), "shingles")
    rows = found.where("kind = 0").select("doc_id", "text_hash", "n", "class")
    # frequent shingles: at most MOST_FREQUENT of them, from the highest steps of a histogram of their counts
    counted = found.where("kind = 1").groupBy("class").agg(F.sum("n").alias("df")).where(F.col("df") >= FREQUENT)
    counted = _shared.written(counted.select(F.shiftrightunsigned("class", 32).alias("high"), F.floor(F.log2("df") * 8).cast("int").alias("step")), "frequent")
    least, room = 1 << 30, MOST_FREQUENT
    for step, n in sorted(counted.groupBy("step").count().collect(), reverse=True):  # at most a few hundred steps
        room -= n
        if room < 0:
            break
        least = step
    common = np.unique(counted.where(F.col("step") >= least).select("high").toArrow().column(0).to_numpy().astype(np.uint32))
    frequent = spark.sparkContext.broadcast(common.tobytes())
    total = rows.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total * 0.65) // KEYS_PER_TASK))
    packed = base.select("text").mapInArrow(_keys(k, frequent, tasks, Bands()), "task int, what byte, keys binary, at binary, classes binary, short boolean")
    groups = packed.repartition(tasks, "task").mapInArrow(_groups, "what byte, group long, class long, rep long")
    met = _shared.written(groups.dropDuplicates(["what", "group", "class"]), "groups")
    groups = met.where("what = 0")

    # the sketches of those classes that are in some group
    some = groups.select("class").distinct()
    sketches = found.where("kind = 0 and sketch is not null").select("class", "n", "sketch").join(some, "class", "left_semi").dropDuplicates(["class"])
    sketches = _shared.written(sketches, "sketches")

    # stars: in each group, all members against one
    star = groups.where("class <> rep").select(F.least("rep", "class").alias("u"), F.greatest("rep", "class").alias("v")).distinct()
    near = _shared.written(_similar(star, sketches), "near")
    edges = _verified(near, base, rows, k)
    parts = _shared.connected_components(edges)

    # what still spans components
    fewest = met.where("what = 2").groupBy("group").agg(F.min(F.struct("rep", "class")).alias("least"))
    bases = fewest.select("least.class", F.lit(True).alias("base")).distinct()
    near2 = _spanning(groups.select("group", "class"), parts, sketches, bases)
    if near2.head(1):
        edges = edges.union(_verified(near2, base, rows, k))
        parts = _shared.connected_components(edges)
    _shared.drop(met, sketches, near, near2, counted)

    # class -> smallest doc_id of its component
    least = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    in_part = parts.join(least, parts["node"] == least["class"])
    label = in_part.groupBy("component").agg(F.min("least").alias("component_id"))
    label = in_part.join(label, "component").select("class", "component", "component_id")
    label = label.union(least.join(parts, least["class"] == parts["node"], "left_anti").select("class", "class", "least"))
    out = rows.join(label, "class", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the near-duplicates: of each component the row with the smallest doc_id stays (null last; ties to the smaller text hash, then any one of
    equal rows). Rows without words stay, each of them."""
    found = _shared.written(jaccard_components(docs).where("component is not null").select("doc_id", "text_hash", "component"), "components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = found.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("size")).where("size > 1")
    several = _shared.written(found.join(first, "component").withColumn("stays", order.eqNullSafe(F.col("first"))).groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count("*").alias("n")), "several")
    # rows that go, and rows that are there several times and of which one stays
    key = lambda d, h: F.xxhash64(d, h)
    changed = _shared.written(several.where("not stays or n > 1").select(key("doc_id", "text_hash").alias("k"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "stays"), "changed")
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("i"), F.xxhash64(docs["text"]).alias("x"))
    row = _shared.marked(row.withColumn("key", key("i", "x")), F.col("key"), changed)
    same = (F.col("key") == F.col("k")) & F.col("i").eqNullSafe(F.col("d")) & (F.col("x") == F.col("h"))
    told = row.where("may_").join(changed, same, "left")
    out = row.where("not may_").select("row.*").union(told.where("k is null").select("row.*"))
    again = changed.where("stays")
    if again.head(1):
        one = told.where("stays").select("key", "i", "x", "row").dropDuplicates(["key", "i", "x"])
        out = out.union(one.select("row.*"))
    return out


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
