"""Media columns: interleaved sequences of text and media, with payloads resolved by digest."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, maybe_broadcast

#: References to one digest from which they are dealt over several tasks of the join, as many to each.
HOT = 512
#: Pixels of a stored row, bytes of a row, and the prefix of a reference by digest.
WIDTH, ROW_BYTES, SCHEME = 64, 192, "sha256:"
_MEDIA = {"img", "audio", "video", "source", "embed"}
_HIDDEN = {"script", "style", "template"}
_BREAKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "tr", "td", "th", "table", "br", "hr", "blockquote", "pre", "nav", "header", "footer", "figure", "body"}


class SequenceParser(HTMLParser):
    """Collects ordered items: ["text", text, None, None] and ["media", None, reference, caption].

    Text runs to the next block tag or medium, with white space collapsed. A caption is the
    figcaption of the medium's figure, wherever that stands in it, else the alt text. One
    that is not closed ends with its figure or the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.run: list[str] = []
        self.hidden = 0
        self.figures: list[list] = []  # media of each open figure, and its caption
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _BREAKS:
            self.flush()
        if tag == "figure":
            self.figures.append([[], None])
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _MEDIA:
            have = dict(attrs)
            if src := have.get("src"):
                self.flush()
                self.items.append(["media", None, src, have.get("alt") or None])
                if self.figures:
                    self.figures[-1][0].append(self.items[-1])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _HIDDEN or tag in ("figure", "figcaption"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            if self.figures:
                self.figures[-1][1] = text or None
        elif tag == "figure" and self.figures:
            if self.caption is not None:
                self.handle_endtag("figcaption")
            media, caption = self.figures.pop()
            for item in media:
                item[3] = caption or item[3]
        if tag in _BREAKS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[list]:
    parser = SequenceParser()
    parser.feed(html or "")
    parser.close()
    while parser.figures:
        parser.handle_endtag("figure")
    parser.flush()
    return parser.items


def sequences(pages: DataFrame, html: Column, keep: list[str]) -> DataFrame:
    """keep plus ``items``: array<struct<pos, kind, text, ref, caption>> of each page, in reading order."""
    kinds = dict(pages.dtypes)
    item = "array<struct<pos: int, kind: string, text: string, ref: string, caption: string>>"
    names = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(pos=i, kind=k, text=t, ref=r, caption=c) for i, (k, t, r, c) in enumerate(parse_html(x))] for x in batch.column(0).to_pylist()]
            kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i + 1) for i in range(len(names))), pa.array(rows, kind)], names=[*names, "items"])

    data = pages.select(html.alias("_html"), *[F.col(c).alias(n) for c, n in zip(keep, names)])
    out = data.mapInArrow(run, "".join(f"{n} {kinds[c]}, " for n, c in zip(names, keep)) + f"items {item}")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "items")


def padded(raw: Column) -> Column:
    """The bytes with spaces after them up to a positive multiple of a row."""
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / F.lit(ROW_BYTES))) * ROW_BYTES
    return F.rpad(raw, size.cast("int"), F.lit(b" "))


def as_image(payload: Column) -> Column:
    """The payload as a binary portable pixmap: a text header, then three 8-bit samples a pixel."""
    rows = (F.octet_length(payload) / F.lit(ROW_BYTES)).cast("int").cast("string")
    return F.concat(F.encode(F.concat(F.lit(f"P6\n{WIDTH} "), rows, F.lit("\n255\n")), "US-ASCII"), payload)


_HEADER = re.compile(rb"P6\s+(\d+)\s+(\d+)\s+255\s")


def samples(media: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of a stored image. An image of another form is an error."""
    head = _HEADER.match(media)
    if not head or len(media) - head.end() != 3 * int(head[1]) * int(head[2]):
        raise ValueError("not a stored image")
    return int(head[1]), int(head[2]), media[head.end() :]


def describe_media(media: bytes) -> tuple[int, str, int, int, str, str]:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, all from the stored bytes."""
    w, h, data = samples(media)
    x = np.frombuffer(data, np.uint8)
    bins = np.bincount(x, minlength=256)
    share = bins[bins > 0] / len(x)
    # 16 bins of 16 values each, the mean and the entropy of the samples, and how much neighbours differ.
    feature = f"{w}x{h}|{'.'.join(map(str, bins.reshape(16, 16).sum(1).tolist()))}|{int(x.sum(dtype=np.int64)) / len(x):.6f}|{float(-(share * np.log2(share)).sum()):.6f}|{int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))}"
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


_DESCRIBED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _DESCRIBED.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = [(d, *describe_media(m.as_py())) for d, m in zip(batch.column(0).to_pylist(), batch.column(1))]
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def store(payloads: DataFrame) -> DataFrame:
    """Write (payload) rows to a media table in the shared folder: (digest, media). Nothing is shuffled."""
    return materialize(payloads.select(F.sha2("payload", 256).alias("digest"), as_image(F.col("payload")).alias("media")), "media")


def described(media: DataFrame) -> DataFrame:
    """What each digest's stored bytes say, read back from the media table. The bytes stay where they are."""
    return media.select("digest", "media").mapInArrow(_describe, _DESCRIBED).dropDuplicates(["digest"])


def resolve(items: DataFrame, media: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each item, with the columns of media for references by digest (null where there is no such digest).

    pos and caption stay with the item they were parsed with. References are counted by
    digest first; those to a hot one are dealt by a hash of themselves, and what is known of
    that medium, which is small, goes to each of the parts.
    """
    flat = items.select(*keep, F.explode("items").alias("item")).select(*keep, "item.*")
    ref = F.when((F.col("kind") == "media") & F.col("ref").startswith(SCHEME), F.substring("ref", len(SCHEME) + 1, 64))
    refs = materialize(flat.withColumn("digest", ref), "media-items")
    hot = refs.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("digest", F.ceil(F.col("n") / HOT).cast("long").alias("parts"))
    hot = materialize(hot, "media-hot")
    few = maybe_broadcast(hot, hot.count(), 96)
    part = F.pmod(F.xxhash64(*keep, "pos"), F.coalesce("parts", F.lit(1).cast("long")))
    dealt = refs.join(few, "digest", "left").withColumn("part", part).drop("parts")
    known = media.join(few, "digest", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))).drop("parts")
    return dealt.join(known, ["digest", "part"], "left").drop("part")


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as a medium of its own page: stored, referred to by digest, resolved, described.

    The UTF-8 bytes of a text are filled up with spaces to a positive multiple of
    ROW_BYTES and kept as a pixmap in a media table. A page is made for each document with
    a heading and a figure that names the payload's digest; parsing it gives the ordered
    items, and the digest join finds what was read back of the stored bytes. Payloads are
    described where they are stored, so the join moves digests and not bytes.

    Returns id, n_bytes (unpadded), payload_bytes, payload_sha256, tail_crc32 (unsigned, of
    the last 16 payload bytes), media_bytes, media_sha256, feature, pos and caption. A null
    text counts as empty and gives one row of spaces. Equal texts give equal values, for
    their digests are one; repeated rows and null ids keep their rows. A very long text is
    one long medium. An empty table gives no rows. Columns other than id and text are not
    read, whatever their names.
    """
    raw = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("raw"))
    full = raw.select("id", F.octet_length("raw").cast("long").alias("n_bytes"), padded(F.col("raw")).alias("payload"))
    media = described(store(full))
    label = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    page = F.concat(F.lit("<article><h1>Document "), label, F.lit(f'</h1><figure><img src="{SCHEME}'), F.sha2("payload", 256), F.lit('" alt="bytes"><figcaption>Text of document '), label, F.lit(", "), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    items = sequences(full, page, ["id", "n_bytes"])
    rows = resolve(items, media, ["id", "n_bytes"]).where("kind = 'media'")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
