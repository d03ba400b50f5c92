"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Overlong documents are first cut into full windows, each a sequence of its own. What is left of each
document, always less than a window, is packed best-fit decreasing: longest first, into the open
window with the least room that still fits, found by a segment tree indexed by remaining room.

The map side tokenises and cuts, so token ids are never shuffled unless asked for; one thin row per
piece is written to the scratch folder. Remainders are dealt by hash into groups of about
`group_rows` (so the number of groups, not their size, grows with the corpus) and each group is
packed by one task. With thousands of pieces a group, best fit leaves well under 1 % unused.

Defined cases: a null or empty text is only its end id; repeated rows are packed as often as they
occur; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import _WORKER, LONGEST, library_ids, load_tokenizer

_END_BYTES = 4
#: What a worker's cache of ids may hold, and what an entry needs besides its word and ids.
CACHE_BYTES, _ENTRY_BYTES = 160 << 20, 140
#: Texts that are encoded at once, and characters after which no more are added.
_CHUNK, _CHUNK_CHARS = 512, 4 << 20


class RoomTree:
    """Open windows by remaining room; `tightest(n)` is the least room of at least n."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.holds = bytearray(2 * self.size)
        self.windows: list[list] = [[] for _ in range(window + 1)]

    def add(self, room: int, window) -> None:
        self.windows[room].append(window)
        at = room + self.size
        while at and not self.holds[at]:
            self.holds[at] = 1
            at >>= 1

    def take(self, room: int):
        window = self.windows[room].pop()
        if not self.windows[room]:
            at = room + self.size
            self.holds[at] = 0
            while at > 1 and not self.holds[at ^ 1]:
                at >>= 1
                self.holds[at] = 0
        return window

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.holds[at]:
            return least
        while at > 1:
            if not at & 1 and self.holds[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.holds[2 * at])
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window number, offset in it) of each length; lengths are at most `window`."""
    tree, used = RoomTree(window), []
    number, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[i]
        room = tree.tightest(n)
        if room is None:
            w = len(used)
            used.append(0)
        else:
            w = tree.take(room)
        number[i], offset[i] = w, used[w]
        used[w] += n
        if used[w] < window:
            tree.add(window - used[w], w)
    return number, offset


def _latin_table(of: Callable[[str], str]) -> bytes:
    """For bytes.translate over Latin-1 text."""
    return "".join(map(of, map(chr, range(256)))).encode("latin-1")


#: Lower case, and a space for a newline.
_LOWER = _latin_table(lambda c: " " if c == "\n" else c.lower())
#: Full stops and commas, what they may stand behind to be cut off, all other marks.
_KINDS = _latin_table(lambda c: "." if c in ".," else "a" if c in " \n" or c.isalnum() else "_")


def _spaced(text: str) -> str:
    """The text with a space wherever it is cut: at spaces and newlines, where a tokenizer that drops
    white space always cuts, and before a full stop or comma after a letter or digit, where its pattern does.

    Latin-1 text is lower-cased at once, as the tokenizer would; a text that may hold a special
    string or other scripts is only cut at its spaces and newlines.
    """
    if "<|" in text:
        return text.replace("\n", " ")
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return text.replace("\n", " ")
    kinds, raw = raw.translate(_KINDS), raw.translate(_LOWER)
    if b"_." not in kinds and b".." not in kinds:
        raw = raw.replace(b".", b" .").replace(b",", b" ,")
    return raw.decode("latin-1")


def _bounds(path: str) -> tuple[np.ndarray, str, int]:
    """Which ids end a pre-token, and a special string with its id; without one, an empty string."""
    key = ("bounds", path)
    if key not in _WORKER:
        tokenizer = load_tokenizer(path)
        vocab, suffix = tokenizer.get_vocab(), getattr(tokenizer.model, "end_of_word_suffix", None)
        ends = np.zeros(max(vocab.values(), default=-1) + 1, bool)
        if suffix:
            ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        added = tokenizer.get_added_tokens_decoder().items()
        apart = [(t.content, i) for i, t in added if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        _WORKER[key] = ends, *(apart[0] if apart else ("", -1))
    return _WORKER[key]


def _encode_words(words: list[str], path: str) -> dict[str, bytes]:
    """Each word's ids. Many words are encoded as one text: words of letters only are single pre-tokens,
    told apart by the ids that end one; between other words stands a special string, told by its id.
    Where the numbers of words and bounds differ, the library is asked for each word, as for long ones."""
    tokenizer, out = load_tokenizer(path), {}
    ends, special, special_id = _bounds(path)

    def together(part: list[str], between: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, "<u4")

    def share(part: list[str], ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        data = ids.tobytes()
        out.update((w, data[i:j]) for w, i, j in zip(part, (4 * starts).tolist(), (4 * stops).tolist(), strict=True))

    plain, rest, each = [], [], []
    for w in words:
        (each if len(w) > LONGEST else plain if w.isalpha() else rest).append(w)
    for at in range(0, len(plain), 5_000):
        part = plain[at : at + 5_000]
        ids = together(part, " ")
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) == len(part) and stops[-1] == len(ids):
            share(part, ids, np.append(0, stops[:-1]), stops)
        else:
            rest += part
    for at in range(0, len(rest), 5_000):
        part = rest[at : at + 5_000]
        ids = together(part, f" {special} ")
        stops = np.flatnonzero(ids == special_id)
        if special and len(stops) == len(part) - 1:
            share(part, ids, np.append(0, stops + 1), np.append(stops, len(ids)))
        else:
            each += part
    for at in range(0, len(each), 10_000):
        part = each[at : at + 10_000]
        out.update((w, np.array(ids, "<u4").tobytes()) for w, ids in zip(part, library_ids(tokenizer, part), strict=True))
    return out


def _held(words: list[str]) -> int:
    """About the bytes that the cache needs for words, besides their ids."""
    return sum(map(sys.getsizeof, words)) + _ENTRY_BYTES * len(words)


def _word_ids(words: list[str], path: str, cache_size: int, cache_bytes: int) -> list[bytes]:
    """The ids of different words, from the worker's cache of two generations where it has them.

    A word is looked for in the younger, then the older one, from which it moves to the younger. When the
    younger would outgrow half of the bounds it becomes the older one, so what is met now and then stays
    and what was met once goes. A chunk that alone outgrows half of them is not kept as the older one.
    """
    young, old = _WORKER.setdefault(("ids", path), {}), _WORKER.setdefault(("older ids", path), {})
    size = ("ids held", path)
    out = list(map(young.get, words))
    absent = [i for i, ids in enumerate(out) if ids is None]
    own = [words[i] for i in absent]
    found = {w: ids for w in own if (ids := old.pop(w, None)) is not None} if old else {}
    found.update(_encode_words([w for w in own if w not in found], path))
    for i, w in zip(absent, own, strict=True):
        out[i] = found[w]
        if len(w) > LONGEST:
            del found[w]
    need = _held(list(found)) + sum(map(len, found.values()))
    if young and (2 * (len(young) + len(found)) > cache_size or 2 * (_WORKER.get(size, 0) + need) > cache_bytes):
        keep = 2 * len(young) <= cache_size and 2 * _WORKER.get(size, 0) <= cache_bytes
        _WORKER[("older ids", path)], _WORKER[size] = young if keep else {}, 0
        young = _WORKER[("ids", path)] = {}
    young.update(found)
    _WORKER[size] = _WORKER.get(size, 0) + need
    return out


def encode_texts(texts: list[str], tokenizer_path: str, end_id: int, cache_size: int = 700_000, cache_bytes: int = CACHE_BYTES) -> list[bytes]:
    """Each text's ids and the end id as little-endian 32-bit numbers.

    For a tokenizer that lower-cases, drops white space and sets letters apart from marks. Words'
    ids are cached by the worker, those of up to LONGEST characters, in `cache_size` entries and about
    `cache_bytes` bytes, besides the words of the texts at hand: _CHUNK, and one more than _CHUNK_CHARS
    characters, at most. Arrow splits these and numbers their different words; only those are looked up.
    """
    out, part, chars = [], [], 0
    for k, text in enumerate(texts, 1):
        part.append(_spaced(text))
        chars += len(text)
        if k < len(texts) and len(part) < _CHUNK and chars < _CHUNK_CHARS:
            continue
        cut = pc.split_pattern(pa.array(part, pa.large_string()), " ")
        words = cut.flatten().dictionary_encode()
        own = _word_ids(words.dictionary.to_numpy(zero_copy_only=False).tolist(), tokenizer_path, cache_size, cache_bytes)
        data = np.frombuffer(b"".join(own) + end_id.to_bytes(_END_BYTES, "little"), "<u4")
        lengths = np.append(np.fromiter(map(len, own), np.int64, len(own)) // _END_BYTES, 1)
        last = cut.offsets.to_numpy()[1:]
        word = np.insert(words.indices.to_numpy(), last, len(own))  # the end id is one more word
        length = lengths[word]
        upto = np.cumsum(length)
        ids = data[np.arange(upto[-1]) + np.repeat((np.cumsum(lengths) - lengths)[word] - upto + length, length)].tobytes()
        stops = (_END_BYTES * upto[last + np.arange(len(part))]).tolist()
        out += [ids[i:j] for i, j in zip([0, *stops], stops)]
        part, chars = [], 0
    return out


def cut_documents(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, text: str, id_col: str, with_ids: bool, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row per piece: (piece_key, id, start, length, ids_crc32, doc_tokens[, ids])."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"piece_key long, id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, len(batch), _CHUNK):
                part = batch.iloc[at : at + _CHUNK]
                rows = []
                for i, ids in zip(part["id"], encode_texts(list(part["t"]), tokenizer_path, end_id, cache_bytes=cache_bytes), strict=True):
                    n, view = len(ids) // 4, memoryview(ids)
                    for start in range(0, n, window):
                        own = view[4 * start : 4 * (start + window)]
                        rows.append((key, i, start, len(own) // 4, zlib.crc32(own), n, *([bytes(own)] if with_ids else [])))
                        key += 1
                yield pd.DataFrame(rows, columns=["piece_key", "id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).mapInPandas(cut, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, text: str = "text", id_col: str = "doc_id", group_rows: int = 16_384, with_ids: bool = False, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row per piece with its sequence and its offset there; `ids` too on request."""
    pieces = written(cut_documents(docs, tokenizer_path, window, end_id, text, id_col, with_ids, cache_bytes), "pieces")
    full = pieces.filter(F.col("length") == window).withColumns({"sequence_id": F.col("piece_key") * 2 + 1, "offset": F.lit(0).cast("long")})
    rest = pieces.filter(F.col("length") < window)
    groups = max(1, -(-rest.count() // group_rows))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece_key", ignore_index=True)
        number, offset = best_fit_decreasing(rows["length"].tolist(), window)
        return pd.DataFrame({"piece_key": rows["piece_key"], "sequence_id": [2 * (int(key[0]) << 31 | w) for w in number], "offset": offset})

    grouped = rest.withColumn("_group", F.pmod(F.xxhash64("piece_key"), F.lit(groups))).select("_group", "piece_key", "length")
    placed = grouped.groupBy("_group").applyInPandas(pack, "piece_key long, sequence_id long, offset long")
    return full.unionByName(rest.join(placed, "piece_key")).drop("piece_key").withColumnRenamed("id", id_col)
