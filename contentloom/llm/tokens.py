"""Token ids of whole texts by a public tokenizer whose tokens never span white space.

Such a tokenizer gives a text the ids of its words one after the other. Texts are cut at spaces
and line ends and their words numbered, both in Arrow; each different word of a batch is looked
up once, new words are encoded once and their ids kept. What else a word holds (other white
space, special tokens) is left to the tokenizer.

For tokenizers that mark the last token of a word, words of letters are encoded many at a time
and told apart by that mark; words of letters and the signs after them are these two parts.
"""

import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from contentloom.llm.texts import in_batches, narrow

KEPT_WORDS = 300_000
#: Bytes of text whose words are numbered together; the more, the fewer look-ups.
NUMBERED_BYTES = 8_000_000


class Encoder:
    """Ids of texts as little-endian unsigned numbers of two bytes (four for large vocabularies)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores out
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        # Words met since the last turn, and those met before it. Words met again stay.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(self.suffix)]] = True
        # An apostrophe may be of one token with the letters after it; special tokens are not cut.
        special = {t.content[0] for t in self.tokenizer.get_added_tokens_decoder().values()}
        signs = "".join(c for c in string.punctuation if c != "'" and c not in special)
        self.parts = rf"^(?P<stem>\pL+)(?P<end>[{re.escape(signs)}]*)$"
        self.letters: dict[str, bool] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """The ids of each text of a column without nulls, as binary."""
        if len(self.kept) > KEPT_WORDS:
            self.kept, self.older = {}, self.kept
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.string()), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        ids = self._word_ids(words.dictionary).take(words.indices)
        return pc.binary_join(pa.ListArray.from_arrays(split.offsets, ids), b"")

    def counts(self, ids: pa.Array) -> pa.Array:
        """How many ids each value of a binary column holds."""
        return pc.divide(pc.binary_length(ids).cast(pa.int64()), self.dtype.itemsize)

    def _word_ids(self, words: pa.Array) -> pa.Array:
        """Words of letters and the signs after them get the ids of these two, both words themselves."""
        if not self.suffix:
            return self._kept_ids(words)
        parts = pc.extract_regex(words, self.parts)
        stems, ends = pc.struct_field(parts, "stem"), pc.struct_field(parts, "end")
        letters = set("".join(strings(stems.filter(pc.invert(pc.string_is_ascii(stems))))))
        self.letters.update((c, self._is_letter(c)) for c in letters.difference(self.letters))
        odd = "".join(c for c in letters if not self.letters[c])
        if odd:
            whole = pc.match_substring_regex(stems, f"[{odd}]")
            stems, ends = pc.if_else(whole, None, stems), pc.if_else(whole, None, ends)
        # Case is dropped, and the lower case of ASCII letters among letters depends on nothing else.
        stems = pc.coalesce(pc.ascii_lower(stems), words)
        return pc.binary_join_element_wise(self._kept_ids(stems), self._kept_ids(pc.fill_null(ends, "")), b"")

    def _is_letter(self, c: str) -> bool:
        """Whether the tokenizer takes a letter as one, and not as a sign or as a letter and a mark."""
        ids = self.tokenizer.encode(f"{c}.{c}", add_special_tokens=False).ids
        return int(self.ends[ids].sum()) == 3

    def _kept_ids(self, words: pa.Array) -> pa.Array:
        numbered = words.dictionary_encode()
        different = strings(numbered.dictionary)
        ids = list(map(self.kept.get, different))
        new = [at for at, found in enumerate(ids) if found is None]
        for at, found in zip(new, self._new_ids([different[at] for at in new]), strict=True):
            ids[at] = self.kept[different[at]] = found
        return pa.array(ids, pa.binary()).take(numbered.indices)

    def _new_ids(self, words: list[str]) -> list[bytes]:
        """Of words that are not kept."""
        ids = list(map(self.older.get, words))
        new = [at for at, found in enumerate(ids) if found is None]
        plain = [at for at in new if self.suffix and words[at].isalpha()]
        for n in range(0, len(plain), 4096):
            chunk = plain[n : n + 4096]
            for at, found in zip(chunk, self._joined([words[at] for at in chunk]), strict=True):
                ids[at] = found
        others = [at for at in new if ids[at] is None]
        for at, found in zip(others, self._one_by_one([words[at] for at in others]), strict=True):
            ids[at] = found
        return ids

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in encoded]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Words of letters, in one go. Each has at least one last token: with as many of these as
        there are words, each word has one."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._one_by_one(words)
        whole, cuts = ids.tobytes(), (cuts * self.dtype.itemsize).tolist()
        return [whole[i:j] for i, j in zip([0, *cuts], cuts)]


def strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_ids(docs: DataFrame, path: str, end: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``ids`` (binary) and ``tokens`` of every row; ``end`` is put after each text."""

    def batches_in(batches):
        own = encoder(path)
        tail = b"" if end is None else np.array([end], own.dtype).tobytes()
        for batch in batches:
            for part in in_batches(batch, 1, NUMBERED_BYTES):
                ids = pc.binary_join_element_wise(own.encode_column(part.column(1)), tail, b"")
                yield pa.RecordBatch.from_arrays([part.column(0), ids, own.counts(ids)], names=["id", "ids", "tokens"])

    rows = narrow(docs, id_col, text_col)
    return rows.mapInArrow(batches_in, f"id {dict(rows.dtypes)['id']}, ids binary, tokens long")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``tokens`` of every row."""

    def batches_in(batches):
        own = encoder(path)
        for batch in batches:
            for part in in_batches(batch, 1, NUMBERED_BYTES):
                n = own.counts(own.encode_column(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), n], names=["id", "tokens"])

    rows = narrow(docs, id_col, text_col)
    return rows.mapInArrow(batches_in, f"id {dict(rows.dtypes)['id']}, tokens long")
