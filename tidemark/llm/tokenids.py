"""Token ids in files: frequency ranks in byte-aligned variable-length code with separate control bytes.

Documents are tokenized in doc_id order. An id is written as its rank by frequency in the corpus, so
that frequent tokens take one byte. A rank takes one to four bytes, little-endian; two bits of a
control byte say how many, for four ranks, lowest bits first. Control bytes stand apart from the data,
so a reader takes the lengths of four ranks at once from a table of 256 rows.

The files are Parquet, written and read by Spark's own writers and readers so that they can be in any
store: `data` with a row per document (shard, doc_id, start in the shard, n_tokens, control, data) in
ascending order within and across shards, and `vocabulary` with the id of each rank.

Defined cases: a null text is an empty one, which has the end id alone. Documents of equal doc_id stand in
the order of a hash of their texts; a null doc_id stands first. An empty table gives empty files. Other
columns are not read. Words of any length are encoded whole; a very long text takes memory in proportion to it.
"""

from __future__ import annotations

import os
import re
import string
import uuid
import zlib
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, materialize, shared_dir, shuffle_width

END_ID = 2
#: Bytes of text worked off at a time; one longer text is worked off alone.
CHUNK = 16 << 20
#: Latin letters (but one whose lower case is two characters), and marks that end a piece of letters for the tokenizer.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
MARKS = re.escape(string.punctuation)
#: Pieces handed to the tokenizer at a time, and how many of letters or of marks in one text.
WORDS = 5_000
JOINED = 200


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_memory: dict = {}


class Encoder:
    """Ids of texts, each distinct word of a chunk encoded once.

    Neither the normalisation of the tokenizer nor its splitting looks across ASCII white space, so the ids
    of a text are those of its words in order."""

    def __init__(self, path: str) -> None:
        if path not in _memory:
            import numpy as np
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            tokenizer = Tokenizer.from_file(path)
            vocabulary = tokenizer.get_vocab()
            ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
            ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
            _memory.clear()
            _memory[path] = tokenizer, ends
        self.tokenizer, self.ends = _memory[path]

    def encode(self, texts):
        """Arrow strings (null: empty) to (ids of all texts, their number in each): the end id is each text's last."""
        import numpy as np

        sizes = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int64 if str(texts.type) == "large_string" else np.int32)[texts.offset :][: len(texts) + 1]))
        cuts, at = [0], 0
        while at < len(texts):
            at = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, "right")))
            cuts.append(at)
        ids, n = zip(*(self._encode(texts[a:b]) for a, b in zip(cuts, cuts[1:]))) if len(texts) else ((np.zeros(0, np.uint32),), (np.zeros(0, np.int64),))
        return np.concatenate(ids), np.concatenate(n)

    def _encode(self, texts):
        import numpy as np
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        flat, start, n = self._words(coded.dictionary)
        ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        end = len(n)
        flat, start, n = np.r_[flat, np.uint32(END_ID)], np.r_[start, len(flat)], np.r_[n, 1]
        word = np.insert(coded.indices.to_numpy(zero_copy_only=False), ends[1:], end)
        own = n[word]
        after = np.cumsum(own)
        at = np.repeat(start[word] - (after - own), own)
        at += np.arange(len(at))
        of_text = np.diff(after[ends[1:] + np.arange(len(texts))], prepend=0)
        return flat[at], of_text

    def _words(self, words):
        """Distinct words to (ids, where each word's begin, their number).

        Letters and the ASCII marks behind them are pieces of their own for the tokenizer, which lower-cases
        all, so of `Word`, `word` and `word,` it is handed `word` and `,` once."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lettered = pc.match_substring_regex(words, f"^[{LETTERS}]+[{MARKS}]*$")
        marked = pc.match_substring_regex(words, f"^[{LETTERS}]+[{MARKS}]+$")
        first = pc.if_else(lettered, pc.ascii_lower(pc.ascii_rtrim(words, string.punctuation)), words)
        at = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        second = pc.replace_substring_regex(words.take(pa.array(at)), f"^[{LETTERS}]+", "")
        pieces = pa.chunked_array([first, second], type=words.type).combine_chunks().dictionary_encode()
        flat, start, n = self._pieces(pieces.dictionary)
        code = pieces.indices.to_numpy(zero_copy_only=False)
        piece = np.insert(code[: len(words)], at + 1, code[len(words) :])
        own = n[piece]
        after = np.cumsum(own)
        place = np.repeat(start[piece] - (after - own), own)
        place += np.arange(len(place))
        last = np.arange(len(words))
        last[at] += 1
        last += np.cumsum(np.bincount(at, minlength=len(words))) - np.bincount(at, minlength=len(words))
        ends = after[last] if len(words) else after
        size = np.diff(ends, prepend=0)
        return flat[place], ends - size, size

    def _pieces(self, pieces):
        """The same for pieces. Those of letters alone or marks alone go to the tokenizer many in a text, between
        spaces: a token that ends a word ends each of them."""
        import numpy as np
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(pieces, f"^([{LETTERS}]+|[{MARKS}]+)$").to_numpy(zero_copy_only=False)
        order, flat, sizes = [], [], []
        for where, joined in ((plain, True), (~plain, False)):
            at = np.flatnonzero(where)
            for low in range(0, len(at), WORDS):  # what the library returns takes far more than the ids
                own = at[low : low + WORDS]
                ids, n = self._run(pieces.take(own).to_pylist(), joined)
                order.append(own)
                flat.append(ids)
                sizes.append(n)
        if not order:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        order, sizes = np.concatenate(order), np.concatenate(sizes)
        start, n = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        start[order], n[order] = np.cumsum(sizes) - sizes, sizes
        return np.concatenate(flat), start, n

    def _run(self, texts: list[str], joined: bool):
        import numpy as np

        given = [" ".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)] if joined else texts
        found = [e.ids for e in self.tokenizer.encode_batch_fast(given, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))
        if not joined:
            return ids, n
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(texts):  # a vocabulary that doesn't mark where words end
            return self._run(texts, False)
        return ids, np.diff(ends, prepend=0)


def pack(ranks) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of ranks."""
    import numpy as np

    r = np.ascontiguousarray(ranks, "<u4")
    more = (r > 0xFF).astype(np.uint8)
    if len(r) and int(r.max()) > 0xFFFF:
        more += (r > 0xFFFF).view(np.uint8) + (r > 0xFFFFFF).view(np.uint8)
        data = r.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= more[:, None]]
    else:  # one byte or two, as for any vocabulary of 65,536 ids or fewer
        held = np.ones((len(r), 2), bool)
        held[:, 1] = more
        data = r.astype("<u2").view(np.uint8)[held.ravel()]
    four = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    four[: len(r)] = more
    a, b, c, d = four.reshape(-1, 4).T
    return (a | b << 2 | c << 4 | d << 6).tobytes(), data.tobytes()


def _lengths():
    """Bytes beyond the first of the four ranks of each control byte."""
    import numpy as np

    return (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8)


def unpack(control: bytes, data: bytes, n: int, table=None):
    """The n ranks behind control and data bytes. table: `_lengths()`, where many are unpacked."""
    import numpy as np

    table = _lengths() if table is None else table
    more = table[np.frombuffer(control, np.uint8)].ravel()[:n]
    if not n or more.max() > 1:
        out = np.zeros((n, 4), np.uint8)
        out[np.arange(4, dtype=np.uint8) <= more[:, None]] = np.frombuffer(data, np.uint8)
        return out.view("<u4").ravel()
    held = np.ones((n, 2), bool)
    held[:, 1] = more
    out = np.zeros(2 * n, np.uint8)
    out[held.ravel()] = np.frombuffer(data, np.uint8)
    return out.view("<u2").astype("<u4")


def write(docs: DataFrame, path: str | None = None, vocabulary: str | None = None) -> str:
    """Write the files of docs; returns the folder."""
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"

    def tokenize(batches):
        from pyspark import TaskContext

        encoder, shard, start = Encoder(vocabulary), TaskContext.get().partitionId(), 0
        for b in batches:
            ids, n = encoder.encode(b.column("text"))
            starts = start + np.cumsum(n) - n
            start += len(ids)
            tally = [None] * len(n)
            if len(n):
                count = np.bincount(ids)
                seen = np.flatnonzero(count)
                tally[0] = np.stack([seen, count[seen]]).astype("<u4").tobytes()
            kind = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
            after = np.r_[0, np.cumsum(n)] * np.dtype(kind).itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(after), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(n), pa.int32()), b.column("doc_id"), pa.array(starts), pa.array(n), packed, pa.array(tally, pa.binary())],
                names=["shard", "doc_id", "start", "n_tokens", "ids", "tally"],
            )

    def counted(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column("tally").to_pylist():
                if x is not None:
                    seen, count = np.frombuffer(x, "<u4").reshape(2, -1)
                    if len(seen) and seen[-1] >= len(total):
                        total = np.r_[total, np.zeros(int(seen[-1]) + 1 - len(total), np.int64)]
                    total[seen] += count
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    tie = F.xxhash64("text").alias("tie")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie, F.monotonically_increasing_id().alias("row"))
    # rows equal in both may lie in several ranges, in any order
    ordered = ordered.repartitionByRange(shuffle_width(spark), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    raw = materialize(ordered.mapInArrow(tokenize, "shard int, doc_id long, start long, n_tokens long, ids binary, tally binary"), "ids")
    # as many rows as the vocabulary has ids, at most
    counts = raw.select("tally").filter("tally IS NOT NULL").mapInArrow(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by_rank = np.array([r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))], np.uint32)
    ranks = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    ranks[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shipped = spark.sparkContext.broadcast(ranks)

    def recode(batches):
        for b in batches:
            coded = []
            for x, n in zip(b.column("ids").to_pylist(), b.column("n_tokens").to_pylist()):
                coded.append(pack(shipped.value[np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4")]))
            c, d = zip(*coded) if coded else ((), ())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("shard", "doc_id", "start", "n_tokens")), pa.array(c, pa.binary()), pa.array(d, pa.binary())], names=["shard", "doc_id", "start", "n_tokens", "control", "data"])

    coded = raw.drop("tally").mapInArrow(recode, "shard int, doc_id long, start long, n_tokens long, control binary, data binary")
    coded.write.option("compression", "zstd").parquet(f"{path}/data")
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(f"{path}/vocabulary")
    drop(raw)
    return path


def read(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start over all shards, n_tokens, ids_crc32 of the ids decoded."""
    import numpy as np
    import pyarrow as pa

    table = spark.read.schema("shard int, doc_id long, start long, n_tokens long, control binary, data binary").parquet(f"{path}/data")
    rows = spark.read.schema("rank int, id int").parquet(f"{path}/vocabulary").collect()
    ids_of = np.zeros(len(rows), "<u4")
    for r in rows:
        ids_of[r["rank"]] = r["id"]
    shipped = spark.sparkContext.broadcast(ids_of)

    def decode(batches):
        lengths = _lengths()
        for b in batches:
            crc = [
                zlib.crc32(shipped.value[unpack(c, d, n, lengths)])
                for c, d, n in zip(*(b.column(k).to_pylist() for k in ("control", "data", "n_tokens")))
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("shard", "doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    totals = table.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # one row per file
    before, offsets = 0, []
    for r in totals:
        offsets.append((r["shard"], before))
        before += r["n"]
    known = spark.createDataFrame(offsets, "shard int, before long")
    out = table.mapInArrow(decode, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.join(known, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
