"""BPE with word ends, as batched rounds over flat NumPy arrays.

The words of many texts lie one after another in one array of symbols, a symbol a byte at first (the last byte of a
word is a symbol of its own kind). A round looks up the rank of every two neighbouring symbols, by binary search over
the sorted keys of the merge table, and merges each word's lowest-ranked pair at all its places, from the left and
without overlap. Words that have no pair left leave the array. Three facts keep the ids those of merging one leftmost
pair of lowest rank after another, and the rounds few:

* After a pair is merged, the next place of that pair is the lowest again, unless the new symbol is part of a pair of
  lower rank. Where it is for some symbol (``alone``), a round merges the leftmost place only.
* A symbol stands in the vocabulary, so no symbol ever spans two bytes, or symbols, that stand together in no entry.
* A pair whose rank is lower than that of every entry that spans the place before it or the place after it is merged
  before anything reaches over these places; it is merged in the same round (``bar``).

What is left after some rounds is cut into parts, each with a lowest rank of its own, where two neighbouring symbols,
joined, stand in no entry. So words of a million letters end after few rounds.

Text is prepared as the vocabulary's file says: special tokens are cut out first, what is left is composed (NFC) and
lower-cased code point by code point, and the file's pattern finds the words.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ship_package, trim

#: Characters of text handled at once. Bytes of words merged together (at least one word). Words, and their bytes with those of their ids, kept during a task.
BLOCK, BATCH, KEPT_WORDS, KEPT_BYTES = 1 << 20, 1 << 20, 450_000, 24 << 20
#: Rounds after which what is left is cut.
ROUNDS = 24
#: More than any rank.
NONE = np.int32(1 << 30)


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file, compressed, to travel with the tasks (a vocabulary, not data, bounds its size)."""
    with open(path, "rb") as f:
        return zlib.compress(f.read(), 9)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others for letters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class Encoder:
    """One vocabulary, and the words that a task has merged."""

    def __init__(self, packed: bytes):
        raw = zlib.decompress(packed).decode()
        file = json.loads(raw)
        self.raw, model, steps = raw, file["model"], file["pre_tokenizer"]["pretokenizers"]
        self.pattern = steps[0]["pattern"]["Regex"]
        form = [s["type"] for s in file["normalizer"]["normalizers"]], [s["type"] for s in steps], steps[0]["behavior"], steps[0]["invert"], steps[1]["add_prefix_space"], steps[1]["use_regex"]
        if form != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "Removed", True, False, False) or model["type"] != "BPE" or model["byte_fallback"] or file["decoder"]:
            raise ValueError(f"not a vocabulary of byte-level words with word ends: {form}")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.names = np.empty(max([*vocab.values(), *special.values()]) + 1, dtype=object)
        self.names[:] = ""
        for name, i in (vocab | special).items():
            self.names[i] = name
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int32)
        self._merges(model["merges"], vocab, end, {c: b for b, c in enumerate(letters)})
        self.find, self.own_split = regex.compile(self.pattern).findall, None
        self.fixed = {t: str(i) for t, i in special.items()}
        self.ids: dict[str, str] = dict(self.fixed)
        self.kept = 0

    def _merges(self, merges: list, vocab: dict[str, int], end: str, byte_of: dict[str, int]) -> None:
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        rank = np.arange(len(pairs), dtype=np.int32)
        self.key_base = np.int64(len(self.names))
        keys = left * self.key_base + right
        order = np.lexsort((-rank, keys))  # of equal pairs the last one counts
        order = order[np.concatenate([[True], np.diff(keys[order]) != 0])] if len(order) else order
        self.keys, self.ranks, self.made = keys[order], rank[order], made
        low = np.full(len(self.names), NONE, dtype=np.int32)  # of a symbol: the lowest rank of a pair with it
        np.minimum.at(low, left, rank)
        np.minimum.at(low, right, rank)
        self.alone = low[made] < rank
        # of two bytes: the lowest rank of an entry in which they stand together
        self.spanned = np.full(1 << 16, NONE, dtype=np.int32)
        self.entries = [bytes(byte_of[c] for c in (a + b).removesuffix(end)) for a, b in pairs]
        self.inside: np.ndarray | None = None
        whole, lengths = np.frombuffer(b"".join(self.entries), dtype=np.uint8).astype(np.int32), np.array([len(t) for t in self.entries], dtype=np.int64)
        inner = np.repeat(rank, lengths)
        same = inner[:-1] == inner[1:]
        np.minimum.at(self.spanned, (whole[:-1] << 8 | whole[1:])[same], inner[:-1][same])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.key_base + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def merged(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words whose bytes lie one after another in ``data``, and how many each word has."""
        ends = np.cumsum(sizes)
        sym, bar = self.inner[data], np.full(len(data), NONE, dtype=np.int32)
        bar[1:] = self.spanned[data[:-1].astype(np.int32) << 8 | data[1:]]
        sym[ends - 1] = self.last[data[ends - 1]]
        bar[ends[:-1]] = NONE
        bar[0] = NONE
        word, pos = np.cumsum(bar == NONE, dtype=np.int32), np.arange(len(data), dtype=np.int64)
        rank = np.full(len(data), NONE, dtype=np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._rank(sym[inside].astype(np.int64), sym[inside + 1])
        done: list[tuple] = []
        rounds = 0
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(sym)))
            if (low == NONE).any():
                out = np.repeat(low == NONE, length)
                done.append((pos[out], sym[out]))
                sym, bar, word, pos, rank = (x[~out] for x in (sym, bar, word, pos, rank))
                continue
            at_low = rank == np.repeat(low, length)
            single = self.alone[low]
            if single.any():
                first = np.minimum.reduceat(np.where(at_low, np.arange(len(sym)), len(sym)), begin)
                at_low &= ~np.repeat(single, length)
                at_low[first[single]] = True
            after = np.append(bar[2:], [NONE, NONE])[: len(bar)]
            hit = np.flatnonzero(at_low | ((rank < bar) & (rank < after)))
            if len(hit) > 1:  # of places that follow each other, and share a symbol, every other one
                opens = np.concatenate([[True], np.diff(hit) != 1])
                start = hit[np.maximum.accumulate(np.where(opens, np.arange(len(hit)), 0))]
                hit = hit[(hit - start) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            touched = np.zeros(len(sym), dtype=bool)
            touched[hit] = True
            touched[np.maximum(hit - 1, 0)] = True
            touched[np.maximum(hit - 2, 0)] = True  # the symbol before, where the place between is gone
            sym, bar, word, pos, rank, touched = (x[keep] for x in (sym, bar, word, pos, rank, touched))
            at = np.flatnonzero(touched)
            rank[at] = NONE
            at = at[at + 1 < len(sym)]
            at = at[word[at] == word[at + 1]]
            rank[at] = self._rank(sym[at].astype(np.int64), sym[at + 1])
            rounds += 1
            if rounds % ROUNDS == 0:
                cut = self._cuts(data, pos, word, ends)
                bar[cut + 1] = rank[cut] = NONE
                word = np.cumsum(np.concatenate([[True], word[1:] != word[:-1]]) | (bar == NONE), dtype=np.int32)
        pos, sym = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (pos, sym)
        order = np.argsort(pos, kind="stable")
        return sym[order], np.diff(np.searchsorted(pos[order], np.append(0, ends)))

    def _cuts(self, data: np.ndarray, pos: np.ndarray, word: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols that, joined with the next one of their part, stand in no entry (equal hashes only hide a cut)."""
        if self.inside is None:
            self.inside = np.unique(np.fromiter((hash(t[i:j]) for t in self.entries for i in range(len(t)) for j in range(i + 2, len(t) + 1)), dtype=np.int64))
        at = np.flatnonzero(word[:-1] == word[1:])
        # the second symbol ends where the next one stands, or before; a finished part may lie between
        third = np.append(pos[2:], len(data))[at] if len(at) else at
        stop = np.minimum(third, ends[np.searchsorted(ends, pos[at + 1], side="right")])
        same = np.append(word[2:], -1)[at] == word[at]
        at, stop = at[same], stop[same]
        raw = data.tobytes()
        spans = np.fromiter((hash(raw[a:b]) for a, b in zip(pos[at].tolist(), stop.tolist(), strict=True)), dtype=np.int64, count=len(at))
        found = np.minimum(np.searchsorted(self.inside, spans), len(self.inside) - 1)
        return at[self.inside[found] != spans]

    def learn(self, words: list[str]) -> None:
        """Merge words that are not known yet."""
        at = 0
        while at < len(words):
            raw, size = [], 0
            while at + len(raw) < len(words) and (not raw or size < BATCH):
                raw.append(words[at + len(raw)].encode())
                size += len(raw[-1])
            sym, count = self.merged(np.frombuffer(b"".join(raw), dtype=np.uint8), np.array([len(r) for r in raw]))
            names, upto = list(map(str, sym.tolist())), np.cumsum(count).tolist()
            for word, a, b in zip(words[at : at + len(raw)], [0, *upto], upto, strict=False):
                self.ids[word] = " ".join(names[a:b])
            self.kept += size + sum(map(len, names)) + len(names)
            at += len(raw)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.find(text.lower())
        if any(unicodedata.category(c) == "Cn" for c in set(text)):  # known to a later Unicode, perhaps the file's library's
            return self._later(text)
        return self.find("".join(p.lower() for p in regex.split("(Σ)", unicodedata.normalize("NFC", text))))

    def _later(self, text: str) -> list[str]:
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        if self.own_split is None:
            whole = Tokenizer.from_str(self.raw)
            self.own_split = whole.normalizer.normalize_str, pre_tokenizers.Split(Regex(self.pattern), "removed", True).pre_tokenize_str
        normal, split = self.own_split
        return [w for w, _ in split(normal(text))]

    def words(self, text: str) -> list[str]:
        """The words and special tokens of a text, in order."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return [w for i, p in enumerate(self.special.split(text)) for w in ([p] if i % 2 else self._plain(p))]

    def encode(self, texts: list[str]) -> list[str]:
        """The decimal ids of each text, joined by single spaces."""
        split = [self.words(t) for t in texts]
        wanted = set().union(*split)
        new = wanted.difference(self.ids)
        if len(self.ids) + len(new) > KEPT_WORDS or self.kept > KEPT_BYTES:  # make room: keep this block's words alone
            self.ids = {w: self.ids[w] for w in wanted if w in self.ids} | self.fixed
            self.kept = sum(len(w) + len(i) for w, i in self.ids.items())
        self.learn(list(new))
        return [" ".join(map(self.ids.__getitem__, words)) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The names of ids joined by single spaces (the file has no decoder); ids that no entry has are left out."""
        return " ".join(self.names[i] for i in ids.tolist() if 0 <= i < len(self.names) and self.names[i])


#: What a pass over the texts can return.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encode(docs: DataFrame, path: str, *, outputs: tuple[str, ...] = ("n_tokens", "ids"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the chosen OUTPUTS for each document, from its whole text.

    ``ids`` are the token ids; a special token's own string in a text is that token. ``decoded`` is what these ids
    decode to. A null text counts as empty, and an empty or blank text has no ids. Repeated rows are encoded each;
    an empty table gives an empty result; other columns are not read. Nothing is shuffled, and a lost task starts
    again from its input. A task holds one block of texts and a bounded number of words.
    """
    packed = read_vocabulary(path)
    ship_package(docs.sparkSession)
    need_ids = set(outputs) & {"ids", "decoded", "decoded_sha256"}
    need_text = set(outputs) & {"decoded", "decoded_sha256"}

    def coded(encoder: Encoder, part: list[str]) -> list[pa.Array]:
        joined = encoder.encode(part)
        ids = [np.fromstring(s, dtype=np.int32, sep=" ") for s in joined] if need_ids else []
        texts = [encoder.decode(x) for x in ids] if need_text else []
        made = {
            "n_tokens": lambda: (s.count(" ") + 1 if s else 0 for s in joined),
            "ids": lambda: ids,
            "decoded": lambda: texts,
            "ids_sha256": lambda: (hashlib.sha256(s.encode()).hexdigest() for s in joined),
            "decoded_sha256": lambda: (hashlib.sha256(t.encode()).hexdigest() for t in texts),
        }
        return [pa.array(list(made[name]()), _ARROW[name]) for name in outputs]

    def run(batches):
        encoder = Encoder(packed)
        for batch in batches:
            texts, at = batch.column("text"), 0
            while at < len(texts):
                part, size = [], 0
                while at + len(part) < len(texts) and (not part or size < BLOCK):
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), *coded(encoder, part)], names=["doc_id", *outputs])
                at += len(part)
        del encoder
        trim()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{name} {OUTPUTS[name]}" for name in outputs)]))


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded``: the text of each row's token ids; null ids count as none, ids of no entry are left out.

    Repeated rows are decoded each; an empty table gives an empty result.
    """
    packed = read_vocabulary(path)
    ship_package(encoded.sparkSession)

    def run(batches):
        encoder = Encoder(packed)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [encoder.decode(np.asarray(x or [], dtype=np.int64)) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.array_compact(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, decoded string")
