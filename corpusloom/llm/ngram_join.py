"""Size-aware heavy-light join on the Jaccard similarity of word shingles."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, maybe_broadcast, small_batches, sole_owner
from .components import components

#: Shared list entries that a pair of large sets must have; lists are longer by as many tokens, so no pair is lost.
MATCHES = 2
#: Entries of the two bounded frequency tables, which set the order of tokens and nothing else.
TABLE = 1 << 17
#: Tokens that a task counts at once, and counts below which a table entry is not worth keeping.
CHUNK, LEAST = 1 << 21, 8
#: Sets up to this size are weighed for subset enumeration; cost of an entry of a list against one of a subset.
WEIGHED, LIST_COST = 40, 3.0
#: Tasks among which the list of a token from the frequency table is dealt.
SALTS = 16
#: Partners that meet a hub's text in one piece.
PARTNERS = 64
#: Words whose hash a worker keeps.
WORDS_KEPT = 1 << 16
#: Entries of open lists may meet as many others each before another hub round or keys of two tokens are tried.
FEW_MEETINGS = 4
#: A hub round that links fewer of the open nodes than this share is the last one.
LEAST_LINKED = 0.05
#: Meetings an entry of a list from which the list counts as heavy: the choices that are weighed against each other.
HEAVY = (16, 64, 256, 1024)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0x8EBC6AF09C88C6E3)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _K[3]
    return x ^ (x >> np.uint64(29))


class _Seen(dict):
    """Hashes of words that a worker met; long words are hashed anew each time."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = h
        return h


def words_of(raw: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: A-Z lower-cased, cut at ASCII white space."""
    return raw.lower().split() if raw else []


class WordHasher:
    """64-bit hashes of the words of a text."""

    def __init__(self):
        self.seen = _Seen()

    def words(self, raw: bytes | None) -> np.ndarray:
        words = words_of(raw)
        return np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))


class Counted:
    """Counts of frequent 64-bit keys, found by their leading bits. Of keys that share these the most frequent is kept: the counts only order tokens."""

    BITS = 20

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.int64)
        by = np.lexsort((keys, counts))
        at = keys[by] >> np.uint64(64 - self.BITS)
        self.keys[at], self.counts[at] = keys[by], counts[by]

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.BITS)
        return np.where(self.keys[at] == keys, self.counts[at], 0)


def raw_shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit token for each run of k words; for fewer words one for all of them."""
    size = min(k, len(h))
    if not size:
        return h
    n = len(h) - size + 1
    token = np.full(n, size, np.uint64)
    for j in range(size):
        token = (token + h[j : j + n]) * _K[j % 8] ^ (token >> np.uint64(31))
    return _mix(token)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit tokens."""
    token = np.sort(raw_shingles(h, k))
    return token[np.concatenate([[True], token[1:] != token[:-1]])] if len(token) else token


@dataclass(frozen=True)
class Law:
    """Two sets link when den * intersection >= num * union."""

    k: int
    num: int
    den: int
    boundary: int = 0

    def overlap(self, a: int, b: int) -> int:
        """The least intersection of linked sets of a and b tokens."""
        return -(-self.num * (a + b) // (self.den + self.num))

    def sizes(self, n: int) -> range:
        """Sizes of sets that a set of n can be linked with."""
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def list_length(self, n: int) -> int:
        """Tokens of a set's start, in the common order, of which linked sets share MATCHES."""
        return min(n, n - -(-self.num * n // self.den) + MATCHES)

    def least(self, n, m):
        """overlap() of arrays of sizes."""
        return -(-self.num * (n.astype(np.int64) + m) // (self.den + self.num))

    def may_link(self, n, m, pos, at):
        """Whether sets of n and m tokens can link and a token at places pos and at, from 0, counts for them.

        A linked pair has at most n - overlap and m - overlap tokens that are not shared, so
        MATCHES of the shared ones stand before these places.
        """
        least = self.least(n, m)
        big, small = np.maximum(n, m), np.minimum(n, m)
        return (small * self.den >= big * self.num) & (pos < n - least + MATCHES) & (at < m - least + MATCHES)

    def subset_sizes(self, n: int, most: int) -> list[int]:
        return sorted({self.overlap(n, b) for b in self.sizes(n) if b <= most and self.overlap(n, b) <= min(n, b)})

    def choose(self, histogram: dict[int, int]) -> Law:
        """The boundary of least cost: subsets of the small sets, and list entries of the others and of small ones near the boundary."""
        least = max(1, math.ceil(MATCHES * self.den / self.num))  # below it a pair may share fewer than MATCHES tokens

        def cost(x: int) -> float:
            light = sum(c * sum(math.comb(n, s) for s in self.subset_sizes(n, x)) for n, c in histogram.items() if n <= x)
            return light + LIST_COST * sum(c * self.list_length(n) for n, c in histogram.items() if n * self.den >= self.num * (x + 1))

        return Law(self.k, self.num, self.den, min(range(least, WEIGHED + 1), key=cost))


def subset_tokens(token: np.ndarray, size: int) -> np.ndarray:
    """A hash for each subset of the given size: the sum over all tokens less those left out."""
    m = _mix(token * _K[5])
    gone = len(token) - size
    total = m.sum(dtype=np.uint64)
    if not gone:
        left = np.array([total], np.uint64)
    else:
        at = np.array(list(itertools.combinations(range(len(token)), gone)))
        left = total - m[at].sum(axis=1, dtype=np.uint64)
    return _mix(left * _K[6] + np.uint64(size))


class _Order:
    """Frequent tokens and frequent words with their counts; both bounded. Sent to the tasks as they are, opened there once."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, words: np.ndarray, word_counts: np.ndarray):
        self.sent = (tokens, counts, words, word_counts)
        self.open = None

    def __reduce__(self):
        return _Order, self.sent

    def ranked(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted tokens of a text; the same from rare to common in an order that all sets share; and which of these are in the table.

        Tokens that the table does not have are rare; among them those of rarer words come first.
        """
        if self.open is None:
            t, c, w, n = self.sent
            self.open = Counted(t, c), Counted(w, (np.log2(np.maximum(n, 1)) * 16).astype(np.int64))
        tokens, words = self.open
        all_tokens = raw_shingles(h, k)
        weight, n = np.zeros(len(all_tokens), np.int64), len(all_tokens)
        of_words = words.of(h)
        for j in range(min(k, len(h))):
            weight += of_words[j : j + n]
        by = np.argsort(all_tokens, kind="stable")
        token = all_tokens[by]
        first = np.concatenate([[True], token[1:] != token[:-1]]) if n else np.zeros(0, bool)
        token = token[first]
        count = tokens.of(token)
        order = np.argsort((count << np.int64(16)) + weight[by][first], kind="stable")
        return token, token[order], count[order] > 0


def _census(k: int):
    """Rows (kind, key, n): 0 tokens and 1 words that a task has seen more than once, with counts; 2 set sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_owner("ngram_join")
        hasher = WordHasher()
        held_t: list[np.ndarray] = []
        held_w: list[np.ndarray] = []
        sizes: dict[int, int] = {}
        size = 0

        def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for kind, held, least in ((0, held_t, 2), (1, held_w, 4)):
                if held:
                    key, n = np.unique(np.concatenate(held), return_counts=True)
                    yield rows(kind, key[n >= least], n[n >= least])
                    held.clear()
            size = 0

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                h = hasher.words(text.as_py())
                token = raw_shingles(h, k)
                if len(token) <= WEIGHED + 60:
                    token = shingles(h, k)
                sizes[min(len(token), WEIGHED + 60)] = sizes.get(min(len(token), WEIGHED + 60), 0) + 1
                held_t.append(token)
                held_w.append(h)
                size += len(token)
                if size >= CHUNK:
                    yield from flush()
        yield from flush()
        yield rows(2, np.array(list(sizes), np.int64).view(np.uint64), np.array(list(sizes.values()), np.int64))

    return run


def _signatures(law: Law, order: _Order):
    """id, size, 128-bit set hash, list entries, entries of the table among them, and subset hashes with sizes of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_owner("ngram_join")
        hasher = WordHasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, h1, h2, lists, common, subsets, sizes = [], [], [], [], [], [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    token, ranked, known = order.ranked(hasher.words(text), law.k)
                    size = len(token)
                    # One shingle alone is hashed as its words, so that 64 bits never decide.
                    whole = xxhash.xxh3_128_intdigest(token.tobytes() if size > 1 else b" ".join(words_of(text)[: law.k]))
                    n.append(size)
                    h1.append(whole >> 64)
                    h2.append(whole & (1 << 64) - 1)
                    if size and size * law.den >= law.num * (law.boundary + 1):
                        p = law.list_length(size)
                        lists.append(ranked[:p].view(np.int64))
                        common.append(ranked[:p][known[:p]].view(np.int64))
                    else:
                        lists.append(np.zeros(0, np.int64))
                        common.append(np.zeros(0, np.int64))
                    if 0 < size <= law.boundary:
                        made = [subset_tokens(token, s) for s in law.subset_sizes(size, law.boundary)]
                        subsets.append(np.concatenate(made).view(np.int64))
                        sizes.append(np.repeat(np.array(law.subset_sizes(size, law.boundary), np.int32), [len(x) for x in made]))
                    else:
                        subsets.append(np.zeros(0, np.int64))
                        sizes.append(np.zeros(0, np.int32))
                as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), as_long(h1), as_long(h2), pa.array(lists, kind), pa.array(common, kind), pa.array(subsets, kind), pa.array(sizes, pa.list_(pa.int32()))], names=["id", "n", "h1", "h2", "lists", "common", "subsets", "sizes"])

    return run


def _runs(law: Law):
    """Entries (sig, salt, class, pos, n, node, w) arrive sorted by these. Of each sig that several sets hold, all entries go on, with the hub of their run.

    The hub is, of the sets of one class of sizes, the one in which the token stands nearest
    to the front: it has the fewest tokens of its own, so of a group of near copies it is the
    one closest to all others. An entry that cannot link with its hub by size and places is
    its own hub. Entries of salted sigs all go on, for their like may be under another salt;
    they are marked as spread, and get their hubs later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: list[np.ndarray] | None = None  # the last entry so far, not yet given out, its hub, and whether it continues a run
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy() for i in range(7)]
            hub_ahead, continued = None, False
            if ahead is not None:
                hub_ahead, continued = [x[0] for x in ahead[7:10]], bool(ahead[10][0])
                rows = [np.concatenate([x, y]) for x, y in zip(ahead[:7], rows)]
            sig, salt, of_class, pos, n, node, w = rows
            new = np.concatenate([[True], sig[1:] != sig[:-1]])
            start = np.maximum.accumulate(np.where(new | np.concatenate([[True], of_class[1:] != of_class[:-1]]), np.arange(len(sig)), 0))
            hub = [x[start] for x in (node, n, pos)]
            if hub_ahead is not None:
                for h, x in zip(hub, hub_ahead):
                    h[start == 0] = x
            shared = ~new
            shared[0] = continued
            shared[:-1] |= ~new[1:]
            shared |= salt >= 0
            out = shared.copy()
            out[-1] = False
            yield _entries(law, *(x[out] for x in (sig, salt, of_class, pos, n, node, w)), *(h[out] for h in hub))
            ahead = [*(x[-1:] for x in rows), *(h[-1:] for h in hub), np.array([not new[-1] or (len(new) == 1 and continued)])]
        if ahead is not None and (ahead[10][0] or ahead[1][0] >= 0):
            yield _entries(law, *ahead[:10])

    return run


_ENTRIES = "sig long, class int, spread boolean, node long, n int, pos int, w int, hub long"


def _entries(law: Law, sig, salt, of_class, pos, n, node, w, hub, hub_n, hub_pos) -> pa.RecordBatch:
    spread = salt >= 0
    meets = np.where(w >= MATCHES, law.least(n, hub_n) == pos, law.may_link(n, hub_n, pos, hub_pos))
    cols = (sig, of_class, spread, node, n, pos, w, np.where(spread | ~meets, node, hub))
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["sig", "class", "spread", "node", "n", "pos", "w", "hub"])


def shared_shingles(x: list[bytes], y: list[bytes], k: int) -> tuple[int, int]:
    """Sizes of intersection and union of the shingle sets of two lists of words, from the words themselves."""
    names: dict[bytes, int] = {}
    a, b = (np.array([names.setdefault(w, len(names)) for w in words], np.int64) for words in (x, y))
    size, other = min(k, len(a)), min(k, len(b))
    na, nb = max(0, len(a) - size + 1) * (size > 0), max(0, len(b) - other + 1) * (other > 0)
    if size != other or not size:
        distinct = lambda v, n: n if n < 2 else len(np.unique(np.lib.stride_tricks.sliding_window_view(v, k), axis=0))
        return 0, distinct(a, na) + distinct(b, nb)
    token = np.concatenate([a[:na], b[:nb]])
    for j in range(1, size):  # numbers of the shingles so far, from 0 without gaps, so that no product overflows
        token = np.unique(token * len(names) + np.concatenate([a[j : j + na], b[j : j + nb]]), return_inverse=True)[1]
    u, v = np.unique(token[:na]), np.unique(token[na:])
    both = len(np.intersect1d(u, v, assume_unique=True))
    return both, len(u) + len(v) - both


def _linked(law: Law):
    """(a, b, ok) of pairs, by the words themselves and no hash.

    Rows (hub, part, first, partner, text) arrive sorted by these: the text of a hub, then
    those of its partners. A hub's text is cut once for all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_owner("ngram_join")
        at, hub_words = None, []
        for batch in batches:
            a, b, ok = [], [], []
            for hub, part, later, partner, text in zip(*[batch.column(i).to_pylist() for i in range(4)], batch.column(4).cast(pa.binary())):
                if (hub, part) != at:
                    at, hub_words = (hub, part), []
                words = words_of(text.as_py())
                if not later:
                    hub_words.append(words)
                    continue
                a.append(min(hub, partner))
                b.append(max(hub, partner))
                both = [shared_shingles(x, words, law.k) for x in hub_words]
                ok.append(any(n > 0 and law.den * n >= law.num * union for n, union in both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row, by the links between sets of k-word shingles.

    Two rows link when den * intersection >= num * union of their sets; component_id is
    the smallest id that links reach. Words are cut at ASCII white space with A-Z
    lower-cased; a text of fewer than k words has its whole sequence as its one shingle; a
    null, empty or blank text has none, links with nothing and is its own component.

    Small sets, up to a boundary chosen by cost from the sizes of all sets, enumerate
    their subsets of the sizes that a linked pair must share: a pair of them links only
    if it shares one. Large sets, and small ones near the boundary, enter the inverted
    lists of their rarest tokens, as many as make linked sets meet MATCHES times. The
    order of tokens comes from two bounded tables of counts, so no pair is lost whatever
    they hold. Equal sets are one node, found by a 128-bit hash.

    Nodes first meet the hub of each list they are in, which joins most of each group with
    as many checks as entries; then only pairs whose components still differ are met. While
    many are left and hubs still link, further rounds of hubs follow. In the end lists are
    met entry by entry where that makes few meetings; where it makes many, linked nodes must
    share a second token with the first, so heavy lists are split by keys of two tokens. All
    pairs are checked on their texts, word by word, so hashes never decide a link.

    An empty table gives no rows. Rows with one id are one node; repeated rows count once;
    rows with a null id take the component of their set, null if no other row has it. Ties do
    not arise: components have no order but that of ids. Very long texts have long lists and
    are read one at a time. Other columns are not read, whatever their names.
    """
    law = Law(k, num, den)
    small_batches(docs.sparkSession)
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    census = materialize(thin.select("text").mapInArrow(_census(k), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).where((F.col("kind") == 2) | (F.col("n") >= LEAST)), "nj-census")
    law = law.choose({r.key: r.n for r in census.where("kind = 2").collect()})
    top = [census.where(F.col("kind") == kind).orderBy(F.desc("n"), "key").limit(TABLE).select("key", "n").toPandas() for kind in (0, 1)]
    tokens, counts = top[0]["key"].to_numpy(np.int64).view(np.uint64), top[0]["n"].to_numpy(np.int64)
    order = docs.sparkSession.sparkContext.broadcast(_Order(tokens, counts, top[1]["key"].to_numpy(np.int64).view(np.uint64), top[1]["n"].to_numpy(np.int64)))

    def signatures(batches):
        yield from _signatures(law, order.value)(batches)

    kind = "array<long>"
    sets = thin.mapInArrow(signatures, f"id long, n long, h1 long, h2 long, lists {kind}, common {kind}, subsets {kind}, sizes array<int>")
    # The number of a row is written with it, so all later stages see the same one.
    sets = materialize(sets.withColumn("row", F.monotonically_increasing_id()), "nj-sets")
    nodes = materialize(sets.where("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min(F.struct("id", "row")).alias("m")).select("h1", "h2", F.col("m.id").alias("node"), F.col("m.row").alias("row")), "nj-nodes")
    held = sets.join(maybe_broadcast(nodes.select("row"), nodes.count(), 24), "row", "left_semi").withColumnRenamed("id", "node")
    entries = _first_meetings(held, law)
    links, asked = _by_hubs(entries, thin, law)
    label = components(links)
    open_, lists, size, meetings = _open(entries, label)
    linked, spent, r = 1.0, None, 0
    while meetings > FEW_MEETINGS * size and linked >= LEAST_LINKED:
        r += 1
        hubs = _next_hubs(open_, spent)
        spent = hubs.select("sig", "class", "hub") if spent is None else spent.unionByName(hubs.select("sig", "class", "hub"))
        spent = materialize(spent, "nj-spent")
        met = open_.join(maybe_broadcast(hubs, hubs.count(), 72), ["sig", "class"]).where((F.col("label") != F.col("hub_label")) & _meets(law, "n", "hub_n", "pos", "hub_pos"))
        star = _pairs(met.select(F.col("node").alias("x"), F.col("hub").alias("y"), "w")).join(asked, ["a", "b"], "left_anti")
        checked = _verify(star, thin, law)
        linked = checked.where("ok").count() / max(1, open_.select("node").distinct().count())
        links, asked = links.unionByName(checked.where("ok").select("a", "b")), asked.unionByName(checked.select("a", "b"))
        label = components(_tied(label, checked))
        open_, lists, size, meetings = _open(entries, label)
    found = _verify(_last_meetings(open_, lists, size, meetings, law).join(asked, ["a", "b"], "left_anti"), thin, law)
    label = components(_tied(label, found))
    named = nodes.join(label, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("label"))
    full = sets.where("n > 0").select("id", "n", "h1", "h2").join(named, ["h1", "h2"], "left").select("id", "n", "label")
    out = full.unionByName(sets.where("n = 0").select("id", "n", F.col("id").alias("label")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))


def _first_meetings(held: DataFrame, law: Law) -> DataFrame:
    """Entries of the lists that several nodes are in, each with the hub it meets first."""
    n = F.col("n").cast("int").alias("n")
    of_class = F.floor(F.log("n") / F.lit(math.log(law.den / law.num))).cast("int") if law.num < law.den else F.col("n").cast("int")
    rare = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    in_lists = held.select("node", "n", "common", F.posexplode("lists").alias("pos", "sig")).select("sig", F.when(F.array_contains("common", F.col("sig")), rare).otherwise(F.lit(-1)).cast("int").alias("salt"), of_class.alias("class"), "pos", n, "node", F.lit(1).alias("w"))
    in_subsets = held.select("node", "n", F.explode(F.arrays_zip("subsets", "sizes")).alias("s")).select(F.col("s.subsets").alias("sig"), F.lit(-1).alias("salt"), of_class.alias("class"), F.col("s.sizes").alias("pos"), n, "node", F.lit(MATCHES).alias("w"))
    dealt = in_lists.unionByName(in_subsets).repartition("sig", "salt").sortWithinPartitions("sig", "salt", "class", "pos", "n", "node")
    return materialize(dealt.mapInArrow(_runs(law), _ENTRIES), "nj-entries")


def _by_hubs(entries: DataFrame, thin: DataFrame, law: Law) -> tuple[DataFrame, DataFrame]:
    """Links between entries and the hubs of their lists, and all pairs that were checked.

    Lists of frequent tokens are dealt over salts, so their hubs are found by an aggregate with map-side combine.
    """
    spread = entries.where("spread")
    hubs = spread.groupBy("sig", "class").agg(F.min(F.struct("pos", "n", "node")).alias("h"))
    hubs = materialize(hubs.select("sig", "class", F.col("h.node").alias("hub_node"), F.col("h.n").alias("hub_n"), F.col("h.pos").alias("hub_pos")), "nj-hubs")
    frequent = spread.join(maybe_broadcast(hubs, hubs.count(), 64), ["sig", "class"]).where((F.col("node") != F.col("hub_node")) & _meets(law, "n", "hub_n", "pos", "hub_pos"))
    met = entries.where("node <> hub").select(F.col("node").alias("x"), F.col("hub").alias("y"), "w").unionByName(frequent.select(F.col("node").alias("x"), F.col("hub_node").alias("y"), "w"))
    checked = _verify(_pairs(met), thin, law)
    return checked.where("ok").select("a", "b"), checked.select("a", "b")


def _open(entries: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Entries of the lists whose nodes are not all in one component, these lists with their sizes and meetings, and both in all.

    A meeting is a pair of entries of one list whose components differ.
    """
    marked = entries.drop("hub", "spread").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of = marked.groupBy("sig", "label").agg(F.count("*").alias("k")).groupBy("sig").agg(F.sum("k").alias("size"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    lists = materialize(of.where("squares < size * size").select("sig", "size", ((F.col("size") * F.col("size") - F.col("squares")) / 2).cast("long").alias("meetings")), "nj-lists")
    facts = lists.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("meetings"), F.lit(0))).first()
    open_ = materialize(marked.join(maybe_broadcast(lists.select("sig"), facts[0], 24), "sig", "left_semi"), "nj-open")
    return open_, lists, facts[1], facts[2]


def _next_hubs(open_: DataFrame, spent: DataFrame | None) -> DataFrame:
    """For each list and class the hub of its largest component that had none yet: (sig, class, hub, hub_n, hub_pos, hub_label)."""
    per = open_.groupBy("sig", "class", "label").agg(F.count("*").alias("k"), F.min(F.struct("pos", "n", "node")).alias("h"))
    if spent is None:  # the first round had the first entry of all
        had = per.groupBy("sig", "class").agg(F.min_by("label", "h").alias("label"))
    else:
        had = open_.join(spent.withColumnRenamed("hub", "node"), ["sig", "class", "node"], "left_semi").select("sig", "class", "label").distinct()
    best = per.join(had, ["sig", "class", "label"], "left_anti").groupBy("sig", "class").agg(F.max_by(F.struct("h", "label"), F.struct("k", -F.col("label"))).alias("b"))
    return materialize(best.select("sig", "class", F.col("b.h.node").alias("hub"), F.col("b.h.n").alias("hub_n"), F.col("b.h.pos").alias("hub_pos"), F.col("b.label").alias("hub_label")), "nj-hubs")


def _last_meetings(open_: DataFrame, lists: DataFrame, size: int, meetings: int, law: Law) -> DataFrame:
    """Pairs (a, b) of different components that meet often enough to be checked.

    Light lists pair their entries, and pairs count their meetings. A pair that meets in a
    heavy list has a second token in common, in a list of either kind, and meets under the
    key of both. From which weight a list is heavy is chosen by cost: meetings of the light
    lists against keys of the nodes in heavy ones.
    """
    single = F.col("w") < MATCHES
    weight = (F.col("meetings") / F.col("size")).alias("weight")
    heavy_from = None
    if meetings > FEW_MEETINGS * size:
        weighed = open_.where(single).join(maybe_broadcast(lists.select("sig", weight), lists.count(), 40), "sig")
        many = [F.count_if(F.col("weight") > x).cast("double").alias(f"m{x}") for x in HEAVY]
        per = weighed.groupBy("node").agg(F.count("*").cast("double").alias("all"), *many)
        keys = per.agg(*[F.sum(F.col(f"m{x}") * (F.col("all") - (F.col(f"m{x}") + 1) / 2)) for x in HEAVY]).first()
        light = lists.agg(*[F.sum(F.when(weight <= x, F.col("meetings")).otherwise(0)) for x in HEAVY]).first()
        cost, best = min([(k + m, x) for k, m, x in zip(keys, light, HEAVY) if k is not None], default=(math.inf, None))
        heavy_from = best if cost < meetings else None
    plain = open_
    if heavy_from is not None:
        heavy = materialize(lists.where(weight > heavy_from).select("sig", F.lit(True).alias("heavy")), "nj-heavy")
        flagged = open_.join(maybe_broadcast(heavy, heavy.count(), 24), "sig", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)) & single)
        plain = flagged.where(~F.col("heavy")).drop("heavy")
    x, y = (plain.select("sig", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "pos", "w", "label")]) for s in "xy")
    on = (x["sig"] == y["sig"]) & (F.col("node_x") < F.col("node_y")) & (F.col("label_x") != F.col("label_y"))
    on &= F.when(F.col("w_x") >= MATCHES, _subset_law(law, "n_x", "n_y", "pos_x")).otherwise(_room(law, "n_x", "n_y", "pos_x", "pos_y"))
    out = _pairs(x.join(y, on).select(F.col("node_x").alias("x"), F.col("node_y").alias("y"), F.col("w_x").alias("w")))
    if heavy_from is None:
        return out
    # A node's tokens in the order that all nodes share; a list of a node is as long as its own start of tokens at most.
    own = flagged.where(single).groupBy("node", "label", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "sig", "heavy"))).alias("ts")).where(F.exists("ts", lambda t: t["heavy"]))
    two = lambda t, u: F.struct(F.xxhash64(t["sig"], u["sig"]).alias("key"), u["pos"].alias("pos"))
    both = F.transform("ts", lambda t, i: F.transform(F.filter(F.slice("ts", i + 2, F.size("ts")), lambda u: t["heavy"] | u["heavy"]), lambda u: two(t, u)))
    keyed = materialize(own.select("node", "label", "n", F.explode(F.flatten(both)).alias("k")).select("node", "label", "n", "k.key", "k.pos"), "nj-keys")
    x, y = (keyed.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "pos", "label")]) for s in "xy")
    on = (x["key"] == y["key"]) & (F.col("node_x") < F.col("node_y")) & (F.col("label_x") != F.col("label_y")) & _room(law, "n_x", "n_y", "pos_x", "pos_y")
    return out.unionByName(x.join(y, on).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))).distinct()


def _pairs(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of meetings (x, y, w) that come to MATCHES."""
    return met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")).where(F.col("w") >= MATCHES).select("a", "b")


def _tied(label: DataFrame, checked: DataFrame) -> DataFrame:
    return label.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b").unionByName(checked.where("ok").select("a", "b"))


def _least(law: Law, n: str, m: str) -> Column:
    """Law.overlap as an expression."""
    return F.expr(f"(({law.num} * ({n} + {m})) + {law.den + law.num - 1}) div {law.den + law.num}")


def _room(law: Law, n: str, m: str, pos: str, at: str) -> Column:
    """Law.may_link as an expression."""
    least = _least(law, n, m)
    return (F.least(n, m) * law.den >= F.greatest(n, m) * law.num) & (F.col(pos) < F.col(n) - least + MATCHES) & (F.col(at) < F.col(m) - least + MATCHES)


def _subset_law(law: Law, n: str, m: str, size: str) -> Column:
    """Sets that share a subset meet where it has just the size that they must share."""
    return _least(law, n, m) == F.col(size)


def _meets(law: Law, n: str, m: str, pos: str, at: str) -> Column:
    return F.when(F.col("w") >= MATCHES, _subset_law(law, n, m, pos)).otherwise(_room(law, n, m, pos, at))


def _verify(pairs: DataFrame, thin: DataFrame, law: Law) -> DataFrame:
    """(a, b, ok) of every pair, from the whole texts.

    Of a pair the node in more pairs is the hub. A hub's text is moved once for each
    PARTNERS of its partners, each partner's once for each of its hubs; hubs with many
    partners are dealt over several tasks.
    """
    pairs = materialize(pairs, "nj-pairs")
    n = pairs.count()
    degrees = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("k")), "nj-degrees")
    small = lambda c: maybe_broadcast(degrees.select(F.col("id").alias(c), F.col("k").alias(f"k_{c}")), 2 * n, 32)
    first = F.col("k_a") >= F.col("k_b")
    parts = F.ceil(F.greatest("k_a", "k_b") / PARTNERS)
    stars = pairs.join(small("a"), "a").join(small("b"), "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("partner"), parts.alias("parts"))
    stars = materialize(stars.select("hub", "partner", F.pmod(F.xxhash64("partner"), "parts").cast("int").alias("part")), "nj-stars")
    texts = materialize(thin.join(maybe_broadcast(degrees.select("id"), 2 * n, 24), "id", "left_semi"), "nj-texts")
    named = lambda c: texts.select(F.col("id").alias(c), "text")
    hubs = stars.select("hub", "part").distinct().join(named("hub"), "hub").select("hub", "part", F.lit(False).alias("later"), F.lit(None).cast("long").alias("partner"), "text")
    partners = stars.join(named("partner"), "partner").select("hub", "part", F.lit(True).alias("later"), "partner", "text")
    dealt = hubs.unionByName(partners).repartition("hub", "part").sortWithinPartitions("hub", "part", "later", "partner")
    return materialize(dealt.mapInArrow(_linked(law), "a long, b long, ok boolean").groupBy("a", "b").agg(F.max("ok").alias("ok")), "nj-checked")
