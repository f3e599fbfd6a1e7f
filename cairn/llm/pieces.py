"""SentencePiece encoding and decoding through a table of distinct chunks.

The model's pieces hold whitespace marks only at their start, and no piece holds a
newline, so no merge can cross the place before a run of marks that follows another
character, nor a newline: a text's ids are its chunks' ids, one after another. Each
Python worker keeps a table of the distinct chunks it has met, in this task and the
ones before, has the library segment each new one once, and joins the ids back by
position. `crossing_free` checks the model for that property; for a model without it
whole texts go to the library.

A table holds at most two generations of `TABLE` chunks of up to `LONG` characters, so a
worker's memory does not grow with its input: when the younger is full it becomes the
older, and chunks still in use are taken over. Longer chunks are segmented where they
stand. Nothing is shuffled: a corpus-wide table would need every word of the corpus in
an exchange only to spare a worker's first meeting with a word.

Defined cases: null and empty texts give the end id only; texts of spaces alone keep
their spaces; unknown characters become byte pieces; repeated rows are encoded as rows
of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import ship, text_of

MARK = "▁"
CHUNK = re.compile("\x20*[^\x20\n]+|\x20+|\n")
TABLE = 400_000
LONG = 256


def crossing_free(pieces: list[str]) -> bool:
    """Whether every piece keeps marks at its start and no piece but it alone holds a newline."""
    return all(MARK not in p.lstrip(MARK) and ("\n" not in p or p == "\n") for p in pieces)


class Codec:
    """Encoder and decoder of one task over its table of distinct chunks."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.end = str(self.sp.eos_id())
        self.names = [str(i) for i in range(self.sp.get_piece_size())]
        self.free = crossing_free([self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]) and self.plain()
        self.lead = len(self.sp.encode("\n"))
        self.table: dict[str, str] = {}  # chunk: its ids, space-joined; a chunk that begins with a space has the mark
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}  # chunks that do not decode to themselves: what they decode to

    def plain(self) -> bool:
        """Whether the normaliser only marks spaces and adds one mark in front."""
        probe = "a  b\n c\t d "
        return self.sp.normalize(probe) == MARK + probe.replace(" ", MARK)

    def segment(self, chunks: list[str]) -> None:
        """Add chunks to the table. The library puts a mark in front of a text; behind a newline that mark stands alone."""
        found = self.sp.encode(["\n" + c for c in chunks], num_threads=1)
        back = self.sp.decode(found, num_threads=1)
        names, lead, table = self.names, self.lead, self.table
        for c, ids, text in zip(chunks, found, back):
            table[c] = " ".join([names[i] for i in ids[lead:]])
            if text[1:] != c:
                self.odd[c] = text[1:]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """A text's chunks by position, the mark written as a space."""
        if not text:
            return []
        text = " " + text.replace(MARK, " ")
        if "  " in text or " \n" in text or text.endswith(" "):
            return CHUNK.findall(text)
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append("\n")
            first, *rest = line.split(" ")
            if first:
                out.append(first)
            out += [" " + w for w in rest]
        return out

    def run(self, texts: list[str]) -> list[tuple[str, str]]:
        """The library's ids of whole texts with the end id, space-joined, and the decoded texts."""
        if not self.free:
            ids = self.sp.encode(texts, add_eos=True, num_threads=1)
            return [(" ".join(map(str, x)), y) for x, y in zip(ids, self.sp.decode(ids, num_threads=1))]
        chunks = [self.chunks(t) for t in texts]
        met = set().union(*chunks)
        new = met.difference(self.table)
        if len(self.table) + len(new) > TABLE:
            self.older, self.table = self.table, {}
            new = met
            self.odd = {c: x for c, x in self.odd.items() if c in self.older}
        known = [c for c in new if c in self.older]
        self.table.update(zip(known, map(self.older.__getitem__, known)))
        self.segment([c for c in new if c not in self.older])
        out, of = [], self.table.__getitem__
        for t, x in zip(texts, chunks):
            back = t.replace(MARK, " ")
            if self.odd and any(c in self.odd for c in x):
                back = "".join(self.odd.get(c, c) for c in x)[1:]
            out.append((" ".join([*map(of, x), self.end]), back))
        for c in [c for c in new if len(c) > LONG]:  # long chunks do not stay
            self.table.pop(c), self.odd.pop(c, None)
        return out


def codec_of(model: bytes) -> Codec:
    """The worker's codec, kept between its tasks."""
    import sentencepiece

    kept = sentencepiece.__dict__.setdefault("_cairn_codecs", {})
    name = hashlib.sha256(model).hexdigest()
    if name not in kept:
        kept.clear()
        kept[name] = Codec(model)
    return kept[name]


def _groups(texts):
    """Runs of texts of about four million characters, or one longer text."""
    group, size = [], 0
    for t in texts:
        t = t.as_py() or ""
        if group and size + len(t) > 4_000_000:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _encode(model: bytes, full: bool):
    def run(batches):
        codec = codec_of(model)
        for batch in batches:
            n, digest, back, all_ids = [], [], [], []
            for group in _groups(batch.column("text")):
                for ids, text in codec.run(group):
                    n.append(ids.count(" ") + 1)
                    digest.append(hashlib.sha256(ids.encode()).hexdigest())
                    back.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                    if full:
                        all_ids.append([int(x) for x in ids.split(" ")])
            more = [pa.array(all_ids, pa.list_(pa.int32()))] if full else []
            columns = [batch.column("key"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string()), *more]
            yield pa.record_batch(columns, names=["key", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * full])

    return run


def encode(docs: DataFrame, model: bytes, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row."""
    schema = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of().alias("text"))
    return rows.mapInArrow(_encode(model, ids), schema).withColumnRenamed("key", key)


def _decode(model: bytes):
    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            texts = [sp.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.record_batch([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    return run


def decode(rows: DataFrame, model: bytes, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row's ids."""
    plain = rows.select(F.col(key).cast("long").alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    return plain.mapInArrow(_decode(model), "key long, text string").withColumnRenamed("key", key)


def model_bytes(path: str | None = None) -> bytes:
    """The vocabulary file's bytes, read on the driver; by default the installed public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


ship(__name__)
