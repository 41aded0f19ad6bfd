"""Byte-pair encoding and decoding of whole texts.

Texts are cut into words as the vocabulary file says, and a word is encoded by
backtracking. An Aho-Corasick automaton (over reversed tokens and words, so that matches
ending at a place are the tokens that start there) lists the tokens at every place,
longest first. Left to right, the longest token that may follow the one before it is
taken; a place from which none leads on is marked dead and the choice before it is
revised. Two tokens may be neighbours when the merge rules, run over the text of both,
end in just these two; the answers fill a pair-compatibility table. A cover with
compatible neighbours only is what the merge rules give for the whole word, and only one
exists, so a dead place stays dead and the work is linear in the word's length.
Decoding joins token strings that an offset table cuts out of one string.

Defined cases: a null text counts as empty (no token, digests of the empty string);
special tokens in a text become their ids; extra columns are ignored; repeated rows
give repeated results.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tillroll.llm import textbytes as tb

#: Words and whole chunks whose encoding a task remembers, and token pairs that a worker does;
#: each is emptied when full, words and chunks at the end of the task as well.
REMEMBERED, REMEMBERED_PAIRS = 250_000, 400_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_SPACE = r"\t-\r \x85\xa0  -     　"
_NOT_SPACE = regex.compile(f"[^{_SPACE}]+")
#: Separators that str.split() honours and the vocabulary's rules do not.
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
# Fixed value: the words of a chunk, as the vocabulary file's splitting rule has them.
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: Stands for the word end; no byte is written with it.
_END = "\n"


def _byte_letters() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Vocabulary:
    """Tables of one vocabulary file, given as its text."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        own = lambda t: t.removesuffix(suffix) + _END if suffix and t.endswith(suffix) else t
        self.text_of = {i: own(t) for t, i in model["vocab"].items()}
        self.rank = {
            (own(a), own(b)): k
            for k, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        }
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        # Decoding: token i is blob[offsets[i]:offsets[i + 1]].
        parts = [strings.get(i, "") for i in range(max(strings) + 1)]
        self.blob, self.offsets = "".join(parts), [0]
        for part in parts:
            self.offsets.append(self.offsets[-1] + len(part))
        self.id_of = {t: i for i, t in self.text_of.items()}
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.cut = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self.machine = ahocorasick.Automaton()
        for i, text in self.text_of.items():
            # A token that the merge rules never end in cannot be in a result.
            if len(self._symbols(text)) == 1 or self.merge(text) == [text]:
                self.machine.add_word(text[::-1], (i, len(text)))
        self.machine.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[str, str]] = {}
        self.chunks: dict[str, tuple[str, str]] = {}

    def forget(self) -> None:
        """Workers outlive tasks, which may be of other stages next."""
        self.words.clear()
        self.chunks.clear()

    @staticmethod
    def _symbols(text: str) -> list[str]:
        if text.endswith(_END):
            return [*text[:-2], text[-2:]]
        return list(text)

    def merge(self, text: str) -> list[str]:
        """The merge rules, run to their end."""
        symbols = self._symbols(text)
        rank = self.rank
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:]), key=lambda p: rank.get(p, 1 << 30))
            if best not in rank:
                break
            merged, k = [], 0
            while k < len(symbols):
                if k + 1 < len(symbols) and (symbols[k], symbols[k + 1]) == best:
                    merged.append(best[0] + best[1])
                    k += 2
                else:
                    merged.append(symbols[k])
                    k += 1
            symbols = merged
        return symbols

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            a, b = self.text_of[left], self.text_of[right]
            known = self.pairs[key] = self.merge(a + b) == [a, b]
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs.clear()
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word in byte letters, without its end mark."""
        text = word + _END
        n = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        # The automaton gives the longest of the matches that end at a place first.
        for end, token in self.machine.iter(text[::-1]):
            starts[n - 1 - end].append(token)
        taken: list[tuple[int, int, int]] = []  # id, length, place in its list
        dead = bytearray(n + 1)
        at, k = 0, 0
        pairs = self.pairs
        before = -1
        while at < n:
            tokens = starts[at]
            while k < len(tokens):
                token, length = tokens[k]
                if not dead[at + length]:
                    fits = before < 0 or pairs.get(before << 20 | token)
                    if fits or fits is None and self.compatible(before, token):
                        break
                k += 1
            if k < len(tokens):
                taken.append((token, length, k))
                before, at, k = token, at + length, 0
            else:
                dead[at] = 1
                _, length, k = taken.pop()
                before = taken[-1][0] if taken else -1
                at, k = at - length, k + 1
        return [t[0] for t in taken]

    def _word(self, word: str) -> tuple[str, str]:
        known = self.words.get(word)
        if known is None:
            ids = self.encode_word(word.encode().decode("latin-1").translate(self.letters))
            known = " ".join(map(str, ids)), self.decode(ids)
            if len(word) <= 64:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = known
        return known

    def decode(self, ids: list[int]) -> str:
        blob, offsets = self.blob, self.offsets
        return " ".join([blob[offsets[i] : offsets[i + 1]] for i in ids])

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """A run of text without white space or special tokens, whose words are encoded alone."""
        plain = chunk
        if not plain.isascii():
            plain = unicodedata.normalize("NFC", plain).replace("Σ", "σ")
        words = _WORDS.findall(plain.lower())
        if len(words) == 1:
            found = self._word(words[0])
        else:
            known = [self._word(w) for w in words]
            found = " ".join([k[0] for k in known]), " ".join([k[1] for k in known])
        if len(chunk) <= 64:
            if len(self.chunks) >= REMEMBERED:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def written(self, text: str) -> tuple[str, str]:
        """Decimal ids and decoded tokens of a text, each joined by blanks."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        found = []
        for part in parts:
            if part in self.special:
                token = self.special[part]
                found.append((str(token), self.decode([token])))
                continue
            chunks = _NOT_SPACE.findall(part) if _ODD_SPACE.search(part) else part.split()
            known = self.chunks.get
            found += [known(c) or self._chunk(c) for c in chunks]
        found = [f for f in found if f[0]]
        return " ".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def encode(self, text: str) -> list[int]:
        ids, _ = self.written(text)
        return [int(i) for i in ids.split()]


@functools.lru_cache(maxsize=2)
def _loaded(source: str) -> Vocabulary:
    return Vocabulary(source)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def bpe_digests(docs: DataFrame, vocabulary_path: str, keep_tables: bool = True) -> DataFrame:
    """Token counts and digests of ids and decoded text, one row per document.

    The file is read once by the driver and broadcast (a few MB, whatever the corpus).
    Workers outlive tasks: with ``keep_tables`` the next task finds the vocabulary's tables,
    else they leave the memory to whatever runs next.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches):
        vocabulary = _loaded(source.value)
        for batch in batches:
            counts, ids_of, texts_of = [], [], []
            for value in tb.column(batch, "text"):
                ids, decoded = vocabulary.written(value.as_py() or "")
                counts.append(ids.count(" ") + 1 if ids else 0)
                ids_of.append(_digest(ids))
                texts_of.append(_digest(decoded))
            yield pa.RecordBatch.from_arrays(
                [
                    tb.column(batch, "doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(ids_of, pa.string()),
                    pa.array(texts_of, pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        vocabulary.forget()
        if not keep_tables:
            _loaded.cache_clear()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, SCHEMA)


def bpe_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """The token ids themselves: doc_id and an array of ids."""
    with open(vocabulary_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches):
        vocabulary = _loaded(source.value)
        for batch in batches:
            ids = [vocabulary.encode(t or "") for t in tb.column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [tb.column(batch, "doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, ids array<int>")


def bpe_texts(tokens: DataFrame, vocabulary_path: str) -> DataFrame:
    """Decode arrays of ids: doc_id and text."""
    with open(vocabulary_path, encoding="utf-8") as f:
        source = tokens.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches):
        vocabulary = _loaded(source.value)
        for batch in batches:
            texts = [vocabulary.decode(i or []) for i in tb.column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [tb.column(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    return tokens.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")
