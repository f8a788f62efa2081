"""BPE encoding and decoding with cuts forced by byte pairs that no vocabulary token holds."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat
from operator import add

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, sole_owner

END = "</w>"
# Fixed values of the tokenizer format: what counts as white space, how a text splits into words.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"
#: Characters that str.split() takes for white space and the tokenizer does not.
ODD = regex.compile("[\x1c-\x1f]")
#: Runs and words whose encoding a worker keeps, in each of two generations of runs: by default, and where a worker has room for little else.
KEPT, MORE_KEPT = 100_000, 300_000
#: Letters of a fragment from which its pairs wait in a heap, so that time grows as n log n and not as n squared.
LONG = 64
_NONE = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    odd = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(odd)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a byte-level BPE file whose words end in ``</w>``."""

    def __init__(self, spec: str, keep: int = KEPT):
        self.keep = keep
        data = json.loads(spec)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        named = {i: t for t, i in self.ids.items()} | {x["id"]: x["content"] for x in data["added_tokens"]}
        self.tokens = [named.get(i, "") for i in range(max(named) + 1)]
        #: For the ids of two tokens that merge, the merge's rank and the made token's id as one number.
        self.wide = max(self.ids.values()).bit_length()
        self.low = (1 << self.wide) - 1
        self.merges: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.merges[self.ids[left], self.ids[right]] = rank << self.wide | self.ids[left + right]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(WORDS)
        self.letters = byte_letters()
        self.letter_ids = {x: self.ids[x] for x in self.letters}
        self.end_ids = {x: self.ids[x + END] for x in self.letters}
        #: Letter pairs inside some token. Any other pair marks a cut: no merge can ever span it.
        self.inside = {t[i : i + 2] for t in (x.removesuffix(END) for x in self.ids) for i in range(len(t) - 1)}
        self.kept: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.old: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.kept_words: dict[str, tuple[str, tuple[int, ...]]] = {}

    def fragments(self, word: str) -> list[list[int]]:
        """Ids of the word's byte letters, cut where no token spans; the last letter carries the word end."""
        s = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode("utf-8", "replace")])
        ids = list(map(self.letter_ids.__getitem__, s))
        ids[-1] = self.end_ids[s[-1]]
        inside = self.inside
        if False not in map(inside.__contains__, map(add, s, s[1:])):
            return [ids]
        cuts = [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in inside]
        return [ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)])]

    def merge(self, ids: list[int]) -> list[int]:
        """Join the leftmost pair of lowest rank until no pair has one. Only the two pairs beside a join change rank."""
        if len(ids) >= LONG:
            return self._merge_long(ids)
        of, low = self.merges.get, self.low
        made = list(map(of, zip(ids, ids[1:]), repeat(_NONE)))
        while made and (best := min(made)) < _NONE:
            i = made.index(best)
            ids[i] = new = best & low
            del ids[i + 1], made[i]
            if i:
                made[i - 1] = of((ids[i - 1], new), _NONE)
            if i < len(made):
                made[i] = of((new, ids[i + 1]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same over a linked list, with the pairs in a heap by rank and place; pairs that are gone are passed over."""
        of, n = self.merges.get, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(v, i) for i, pair in enumerate(zip(ids, ids[1:])) if (v := of(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            v, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or of((ids[i], ids[j])) != v:
                continue
            ids[i], ids[j] = v & self.low, -1
            k, h = after[j], before[i]
            after[i] = k
            if k >= 0:
                before[k] = i
                if (x := of((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (x, i))
            if h >= 0 and (x := of((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (x, h))
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> tuple[str, tuple[int, ...]]:
        """Ids of a word, as text and as numbers."""
        made = self.kept_words.get(word)
        if made is None:
            ids = [t for f in self.fragments(word) for t in self.merge(f)]
            made = " ".join(map(str, ids)), tuple(ids)  # the collector passes over tuples of numbers
            if len(word) < 64:
                if len(self.kept_words) >= self.keep:
                    self.kept_words.clear()
                self.kept_words[word] = made
        return made

    def _chunk(self, chunk: str) -> tuple[str, tuple[int, ...]]:
        """The same of a run without white space.

        What was looked up since the last change of generations outlives the next one.
        """
        made = self.old.get(chunk)
        if made is None:
            if chunk.isascii() and chunk.isalpha():
                made = self._word(chunk)
            else:
                parts = [self._word(w) for w in self.words.findall(chunk)]
                made = parts[0] if len(parts) == 1 else (" ".join([x[0] for x in parts]), tuple([i for x in parts for i in x[1]]))
            if len(chunk) >= 64:
                return made
        if len(self.kept) >= self.keep:
            self.old, self.kept = self.kept, {}
        self.kept[chunk] = made
        return made

    def encode(self, text: str) -> tuple[str, list[int]]:
        """Ids of a whole text: decimal, joined by a space, and as numbers."""
        out: list[tuple[str, tuple[int, ...]]] = []
        for part in self.special_at.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append((str(self.special[part]), (self.special[part],)))
                continue
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            chunks = regex.split(f"[{SPACE}]+", plain) if ODD.search(plain) else plain.split()
            make = self._chunk
            out += [self.kept.get(c) or make(c) for c in chunks if c]
        return " ".join([x[0] for x in out if x[1]]), list(chain.from_iterable([x[1] for x in out]))

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, special ones too, joined by a space: the file names no other decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


_MADE: dict[str, WordBpe] = {}


def _encoder(spec: str, keep: int) -> WordBpe:
    key = f"{keep}:{hashlib.md5(spec.encode()).hexdigest()}"
    if key not in _MADE:
        _MADE[key] = WordBpe(spec, keep)
    return _MADE[key]


def bpe(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False, keep: int = KEPT) -> DataFrame:
    """Encode every whole text and decode it again: id, n_tokens, ids_sha256, decoded_sha256.

    The vocabulary file is read by the driver and sent to the tasks; its size is that of
    the tokenizer, not of the data. ids_sha256 is over decimal ids joined by one space,
    decoded_sha256 over the decoded text in UTF-8. with_ids adds ``ids``, with_text
    ``decoded``. A null text counts as empty and has no tokens. Equal texts give equal
    values; rows are independent, so repeated rows and null ids pass as they are. Texts are
    encoded whole; a word of any length takes time as its length times the logarithm of it.
    keep: encodings that a worker keeps. An empty table gives no rows. Columns other than id and text are not read or returned,
    whatever their names. The merge of lowest rank goes first, of equal ones the leftmost.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_owner("bpe", _MADE.clear)
        coder = _encoder(sent.value, keep)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, a, b, ids, texts = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    joined, made = coder.encode(text or "")
                    decoded = coder.decode(made)
                    n.append(len(made))
                    a.append(hashlib.sha256(joined.encode()).hexdigest())
                    b.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        ids.append(made)
                    if with_text:
                        texts.append(decoded)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                cols += [pa.array(ids, pa.list_(pa.int32()))] * with_ids + [pa.array(texts, pa.string())] * with_text
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
