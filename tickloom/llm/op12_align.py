"""Cross-tokenizer alignment: groups of tokens between common byte ends, and the id pairs that they link."""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_batches, written

#: Text bytes whose documents go through NumPy at once; a longer text goes by itself.
ROW_BYTES = 1 << 20
#: Words that a worker remembers between those, some 300 bytes each; of more, half as many stay: the most used.
KNOWN = 1 << 18
#: Characters of a word that is worth remembering.
LONG = 32
#: Words that go to the libraries as one text.
CALL = 512
#: Tokens, of both, whose words are aligned at once; a longer word is aligned by itself.
SHORT = 1 << 16
#: Linked pairs of ids whose counts are broadcast (some 60 bytes each); more are joined by shuffles.
BROADCAST_PAIRS = 1_000_000
#: Where both tokenizers' tokens are sure to end: before a blank that follows neither white space nor U+2581.
#: The blank comes first, as a search for a fixed character is fast.
BORDER = re.compile(r" (?<=[^\s▁\x1c-\x1f] )")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_level() -> dict[str, int]:
    """Byte of each character of the byte-level alphabet: printable Latin-1 characters stand
    for themselves, and the other bytes, in order, for U+0100 and on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairEncoder:
    """Ids and byte ends of a text's tokens under both tokenizers, word by word.

    A word is a blank or more with what follows up to the next BORDER; it goes without its
    first blank. Where the first
    tokenizer cuts by the byte-level pattern and no piece of the second has U+2581 after
    another character, no token crosses a border, so that a text's tokens are those of its
    words; other tokenizers get whole texts as words.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        to_byte = _byte_level()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for piece, i in self.a.get_vocab(with_added_tokens=False).items():
            if all(c in to_byte for c in piece):
                self.a_bytes[i] = bytes(to_byte[c] for c in piece)
        self.b_bytes, crossing = [], False
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            crossing |= re.search("[^▁]▁", piece) is not None
        self.tables = [_table(x) for x in (self.a_bytes, self.b_bytes)]
        self.said = _table([b"%d," % i for i in range(max(len(self.a_bytes), len(self.b_bytes)))])
        kind = type(self.a.pre_tokenizer).__name__ if self.a.pre_tokenizer else ""
        plain = self.a.normalizer is None and [p for p, _ in self.a.pre_tokenizer.pre_tokenize_str(" ab  c")] == ["Ġab", "Ġ", "Ġc"] if kind == "ByteLevel" else False
        self.words_apart = plain and not crossing and self.b.encode("a b") == self.b.encode("a") + self.b.encode("b") and "".join(self.b.encode(" a", out_type=str)) == "▁▁a"

    def words(self, text: str) -> list[str]:
        """The words of space + text, each without its first blank."""
        if not self.words_apart:
            return [text]
        first, *others = BORDER.split(" " + text)
        return [first[1:], *others]

    def encode(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which words have tokens: those whose bytes both give back; and, of all words, number of
        tokens, ids and byte ends under the first and under the second, flat.

        Words that stand apart are joined, many to a text; the tokens are dealt to them by their
        byte ends. A text that either doesn't give back goes word by word."""
        # Behind a word that ends in a blank, only a text's last one, another would not stand apart.
        stops = [i + 1 for i, w in enumerate(words) if not w or w[-1] == "▁" or w[-1].isspace()] if self.words_apart else []
        texts, at = [], 0
        for stop in [*stops, len(words)]:
            while at < stop:
                texts.append(words[at : min(stop, at + (CALL if self.words_apart else 1))])
                at += len(texts[-1])
        joined = [" " + " ".join(t) for t in texts]
        coded = self._coded(joined)
        good, parts = [np.empty(0, bool)], [[np.empty(0, np.int64), *[np.empty(0, np.int32)] * 2] * 2]
        for some, text, *ids in zip(texts, joined, *coded, strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            sizes = np.fromiter(map(len, some if len(raw) == len(text) else map(str.encode, some)), np.int64, len(some)) + 1
            found = [_dealt(i, t, raw, sizes) for i, t in zip(ids, self.tables, strict=True)]
            if None not in found:
                good.append(np.ones(len(some), bool))
                parts.append([x for f in found for x in f])
            elif len(some) > 1:
                for w in some:
                    right, part = self.encode([w])
                    good.append(right)
                    parts.append(part)
            else:
                good.append(np.zeros(1, bool))
                parts.append([np.zeros(1, np.int64), *[np.empty(0, np.int32)] * 2] * 2)
        return np.concatenate(good), [np.concatenate(p) for p in zip(*parts, strict=True)]

    def _coded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text, which starts with a blank, under both."""
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        if " " in texts:  # a text's last blank, for which there is nothing to put a space in front of
            b = [[self.b.piece_to_id("▁")] if t == " " else i for t, i in zip(texts, b, strict=True)]
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], b


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and place of each piece in their joined bytes."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(pieces), np.uint8)


def _joined(ids: np.ndarray, ends: np.ndarray, table: tuple) -> np.ndarray:
    """The joined bytes of these ids' pieces, which end at these places."""
    own, places, held = table
    n = own[ids]
    return held[np.repeat(places[ids] - ends + n, n) + np.arange(ends[-1])]


def _dealt(ids: list[int], table: tuple, raw: np.ndarray, sizes: np.ndarray) -> tuple | None:
    """(tokens a word, ids, byte ends within the word) of a text of words of these sizes; None if
    the tokens' bytes aren't the text's or a token crosses a word's end."""
    flat = np.array(ids, np.int32)
    bounds = np.cumsum(sizes)
    ends = np.cumsum(table[0][flat])
    if not len(ends) or ends[-1] != len(raw) or not np.array_equal(_joined(flat, ends, table), raw):
        return None
    last = np.searchsorted(ends, bounds)
    if not np.array_equal(ends[last], bounds):
        return None
    each = np.diff(last + 1, prepend=0)
    return each, flat, (ends - np.repeat(bounds - sizes, each)).astype(np.int32)


@lru_cache(maxsize=2)
def _encoder(a_path: str, b_path: str) -> PairEncoder:
    return PairEncoder(a_path, b_path)


def _aligned(n_a: np.ndarray, a: np.ndarray, a_ends: np.ndarray, n_b: np.ndarray, b: np.ndarray, b_ends: np.ndarray, said: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of words with tokens: number of groups, number of links, links (flat, a id in the high
    half), and the groups as text, each with a semicolon behind it.

    A group ends where a token of both ends. All words are laid end to end; as each word's end
    is common, no group crosses it."""
    till_a, till_b = np.cumsum(n_a), np.cumsum(n_b)
    size = a_ends[till_a - 1].astype(np.int64)
    start = np.cumsum(size) - size
    a_at, b_at = a_ends + np.repeat(start, n_a), b_ends + np.repeat(start, n_b)
    is_a, is_b = np.zeros((2, int(size.sum()) + 1), bool)
    is_a[a_at] = is_b[b_at] = True
    last_a, last_b = np.flatnonzero(is_b[a_at]), np.flatnonzero(is_a[b_at])
    own_a, own_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    groups = np.searchsorted(last_a, till_a)
    # Links, group by group.
    times = own_a * own_b
    linked = np.cumsum(times)
    of = np.repeat(np.arange(len(times)), times)
    inside = np.arange(len(of)) - (linked - times)[of]
    links = a[(last_a + 1 - own_a)[of] + inside // own_b[of]].astype(np.int64) << 32 | b[(last_b + 1 - own_b)[of] + inside % own_b[of]]
    # Text: a group's tokens of the first, then those of the second, each with a comma behind it but for a group's last ones.
    ids = np.empty(len(a) + len(b), np.int32)
    of_a, of_b = np.repeat(np.arange(len(own_a)), own_a), np.repeat(np.arange(len(own_b)), own_b)
    ids[np.arange(len(a)) + (last_b + 1 - own_b)[of_a]] = a
    ids[np.arange(len(b)) + last_a[of_b] + 1] = b
    ends = np.cumsum(said[0][ids])
    text = _joined(ids, ends, said)
    text[ends[last_a + 1 + last_b - own_b] - 1] = ord("|")
    text[ends[last_a + 1 + last_b] - 1] = ord(";")
    text, cuts = text.tobytes(), ends[till_a + till_b - 1].tolist()
    return np.diff(groups, prepend=0), np.diff(linked[groups - 1], prepend=0), links, [text[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]


def aligned_words(n_a: np.ndarray, a: np.ndarray, a_ends: np.ndarray, n_b: np.ndarray, b: np.ndarray, b_ends: np.ndarray, said: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """_aligned, some words at a time."""
    till_a, till_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    parts, texts, lo = [[np.empty(0, np.int64)] * 3], [], 0
    while lo < len(n_a):
        hi = max(lo + 1, int(np.searchsorted(till_a + till_b, till_a[lo] + till_b[lo] + SHORT, side="right")) - 1)
        in_a, in_b = slice(till_a[lo], till_a[hi]), slice(till_b[lo], till_b[hi])
        *numbers, said_so = _aligned(n_a[lo:hi], a[in_a], a_ends[in_a], n_b[lo:hi], b[in_b], b_ends[in_b], said)
        parts.append(numbers)
        texts += said_so
        lo = hi
    return *(np.concatenate(p) for p in zip(*parts, strict=True)), texts


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs that start here and are so long, one run behind the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordBook:
    """What a worker knows of words, by number: how often they served, their tokens under both,
    groups and links (no tokens: 0), the links themselves and the groups as text.

    It only saves work: what is forgotten is encoded anew."""

    def __init__(self, enc: PairEncoder):
        self.enc = enc
        self._hold([], np.zeros(0, np.int64), np.zeros((4, 0), np.int64), np.zeros(0, np.int64), [])

    def _hold(self, words: list[str], uses: np.ndarray, counts: np.ndarray, links: np.ndarray, said: list[bytes]) -> None:
        self.number = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number.update(zip(words, range(len(words)), strict=True))
        self.chars, self.uses, self.counts, self.links, self.said = sum(map(len, words)), uses, counts, links, said

    def numbers(self, text: str | None) -> np.ndarray:
        """Numbers of a text's words, in order; new words get the next ones, and must be learnt."""
        words = self.enc.words(text) if text else []
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def learn(self) -> None:
        """Tokens, groups and links of all words numbered since."""
        words = list(islice(self.number, len(self.said), None))
        good, (n_a, a, a_ends, n_b, b, b_ends) = self.enc.encode(words)
        n_a, n_b = n_a[good], n_b[good]
        groups, linked, links, said = aligned_words(n_a, a, a_ends, n_b, b, b_ends, self.enc.said)
        counts, said = np.zeros((4, len(words)), np.int64), iter(said)
        counts[:, good] = n_a, n_b, groups, linked
        self.counts = np.concatenate([self.counts, counts], axis=1)
        self.links = np.concatenate([self.links, links])
        self.said += [next(said) if g else b"" for g in good.tolist()]
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        self.chars += sum(map(len, words))

    def trim(self, numbers: np.ndarray) -> None:
        """After a use of these words: forgets words beyond KNOWN."""
        used = np.zeros(len(self.uses), bool)
        used[numbers] = True
        self.uses += used
        if len(self.uses) <= KNOWN and self.chars <= LONG * KNOWN:
            return
        words, linked = list(self.number), self.counts[3]
        short = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) <= LONG)
        kept = np.sort(short[np.argsort(-self.uses[short], kind="stable")[: KNOWN // 2]])
        links = self.links[_runs((np.cumsum(linked) - linked)[kept], linked[kept])]
        self._hold([words[i] for i in kept.tolist()], self.uses[kept] // 2, self.counts[:, kept], links, [self.said[i] for i in kept.tolist()])


@lru_cache(maxsize=2)
def _book(a_path: str, b_path: str) -> WordBook:
    return WordBook(_encoder(a_path, b_path))


_PAIRS = "array<struct<pair:bigint,n:int>>"
_ALIGNED = f"row bigint, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, sha string, links {_PAIRS}, held {_PAIRS}"


def _pairs(lengths: np.ndarray, pairs: np.ndarray, n: np.ndarray) -> pa.Array:
    flat = pa.StructArray.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int32())], ["pair", "n"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), flat)


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each part: number of distinct values; those of all parts, flat, and how often each is there."""
    found = [np.unique(p, return_counts=True) for p in parts]
    none = np.empty(0, np.int64)
    return np.array([len(v) for v, _ in found], np.int64), np.concatenate([none, *(v for v, _ in found)]), np.concatenate([none, *(n for _, n in found)])


def tokenised(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """One row a document, numbered: its numbers of tokens, groups and links, the hash of its
    groups, and its distinct links, each with how often it occurs. The first of the documents
    of up to ROW_BYTES of texts also has, for every pair linked in these, how many hold it."""
    text_batches(docs.sparkSession)
    most = ROW_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, book = TaskContext.get().partitionId() << 32, _book(a_path, b_path)
        ids, texts, size = [], [], 0

        def rows() -> pa.RecordBatch:
            nonlocal ids, texts, size, task
            book.learn()
            texts = [t if book.counts[0, t].all() else t[:0] for t in texts]
            sizes, flat = np.array([len(t) for t in texts], np.int64), np.concatenate(texts)
            ends = np.cumsum(sizes)
            till = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(book.counts[:, flat], axis=1)], axis=1)
            counts = till[:, ends] - till[:, ends - sizes]
            hashes = [hashlib.sha256(b"".join([book.said[i] for i in t.tolist()])[:-1]).hexdigest() if len(t) else "" for t in texts]
            linked = book.counts[3]
            links = book.links[_runs((np.cumsum(linked) - linked)[flat], linked[flat])]
            own = _counted(np.split(links, np.cumsum(counts[3])[:-1]))
            n, *held = _counted([own[1]])
            n = np.concatenate([n, np.zeros(len(ids) - 1, np.int64)])
            book.trim(flat)
            columns = [pa.array(np.arange(task, task + len(ids)), pa.int64()), pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), _pairs(*own), _pairs(n, *held)]
            task += len(ids)
            ids, texts, size = [], [], 0
            return pa.RecordBatch.from_arrays(columns, ["row", "id", "n_a", "n_b", "n_groups", "n_links", "sha", "links", "held"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if size and size + len(t or "") > most:
                    yield rows()
                ids.append(i)
                texts.append(book.numbers(t))
                size += len(t or "") + 50
        if ids:
            yield rows()

    return docs.select(F.col(id_col).cast("bigint").alias("_i"), F.col(text_col).alias("_t")).mapInArrow(run, _ALIGNED)


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Aligns two tokenizers over all texts: (documents, pairs).

    a_path: a byte-level BPE of the tokenizers library; b_path: a sentencepiece model that adds
    a space in front. Both encode space + text. Texts null, empty or whose bytes either doesn't
    give back have no tokens: zeros, and groups_sha256 ''. Special tokens' strings are plain
    text. Every row counts as a document, rows that repeat an id too; null ids stay null;
    other columns are not read; an empty table gives no rows. A text's words and their
    alignment must fit in a task's memory.

    documents: id, n_a, n_b, n_groups, n_links, n_best, count_sum long, groups_sha256 string.
    pairs: a_id int, b_id int, n_docs long, best boolean, for every linked pair of ids.

    Workers remember words, so that groups and links are built once for a frequent one, by
    NumPy within the task; a document has its distinct pairs with their numbers. Documents of a
    pair are counted within some MB of texts, then summed; the counts come back to documents'
    pairs by a broadcast of BROADCAST_PAIRS pairs at most, or else by a join.
    """
    own = default_tokenizers()
    rows = written(tokenised(docs, a_path or own[0], b_path or own[1], id_col, text_col), "aligned")
    # Documents that hold a pair.
    pair = rows.select(F.inline("held")).groupBy("pair").agg(F.sum("n").alias("n_docs"))
    pair = written(pair.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy(F.shiftright("pair", 32)))), "pairs")
    # Per document: sums over its links, each as often as it occurs.
    few = pair.count() <= BROADCAST_PAIRS
    links = rows.select("row", F.inline("links")).join(F.broadcast(pair) if few else pair, "pair")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"))
    out = rows.drop("links", "held").join(sums, "row", "left")
    known = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_best", "count_sum")]
    out = out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *known, F.col("sha").alias("groups_sha256"))
    low = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return out, pair.select(F.shiftright("pair", 32).cast("int").alias("a_id"), low.cast("int").alias("b_id"), "n_docs", "best")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alignment of the 50,257-id byte-level and the 32,000-piece tokenizer over all of `documents`."""
    return alignment(table(spark, sf_dir, "documents"))[0]
