"""Tokens of a byte-level BPE tokenizer for whole Arrow columns, each distinct stretch of text encoded once.

Byte-level pre-tokens never cross certain places, whatever stands around them: before a single
blank between two characters that are no white space, before line feeds after such a character
and after line feeds before one, and between a letter and a following mark of ASCII. A text cut
there gives the tokens of its parts. So Arrow cuts the texts, the tokenizer encodes each distinct
part, and numpy puts the tokens together. Texts with any other white space, or that hold a special
token, are encoded as they are.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Encoded parts that are remembered between slices.
KNOWN = 600_000
#: Parts that are encoded as one text.
TOGETHER = 1_000
#: Put where a text is cut; texts that have it are encoded as they are.
_CUT = "\x01"
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
#: Letters, digits and marks, no white space by any definition.
_SOLID = r"[!-~\p{L}\p{N}]"
_GOOD = rf"\A(?: ?{_SOLID}(?:[^\s\p{{Z}}\p{{C}}]*{_SOLID})?|\n+)?\z"


class Encoder:
    """Encodes columns of texts; made once in a task from the tokenizer's JSON text."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self._model = Tokenizer.from_str(vocabulary)
        self._feed = self._whole("\n")
        special = [re.escape(t.content) for t in self._model.get_added_tokens_decoder().values()]
        self._whole_only = "|".join([_CUT, *special])
        vocabulary = self._model.get_vocab(with_added_tokens=False)
        self._bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # of each token; a character is a byte
        self._bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self._known: dict[str, bytes] = {}  # tokens of 4 bytes

    def _whole(self, text: str) -> tuple:
        return tuple(self._model.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _learn(self, parts: list[str]) -> None:
        """Parts have no white space but a blank before them, or are line feeds.

        Those with a blank are encoded one after another, as they are cut there anyway, and told apart by their bytes;
        others are encoded a line each.
        """
        blank = [part for part in parts if part[0] == " "]
        for at in range(0, len(blank), TOGETHER):
            some = blank[at : at + TOGETHER]
            ids = np.array(self._whole("".join(some)), np.uint32)
            ends = np.cumsum([len(part.encode()) for part in some])
            reached = np.cumsum(self._bytes[np.minimum(ids, len(self._bytes) - 1)])
            bounds = np.searchsorted(reached, ends) + 1
            if bounds[-1] == len(ids) and (reached[bounds - 1] == ends).all():
                self._keep(some, ids, np.append(0, bounds[:-1]), bounds)
            else:
                self._each(some)
        words = [part for part in parts if part[0] not in " \n"]
        ids = np.array(self._whole("\n".join(words)), np.uint32)
        feeds = np.flatnonzero(ids == self._feed[0])
        if len(self._feed) == 1 and len(feeds) == len(words) - 1:
            self._keep(words, ids, np.append(0, feeds + 1), np.append(feeds, len(ids)))
        else:
            self._each(words)
        for part in parts:
            if part[0] == "\n":  # something solid follows, which decides how line feeds are cut
                self._known[part] = np.array(self._whole(part + "x")[:-1], np.uint32).tobytes()

    def _keep(self, parts: list[str], ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        raw = ids.tobytes()
        self._known.update((part, raw[a:b]) for part, a, b in zip(parts, (4 * begins).tolist(), (4 * ends).tolist()))

    def _each(self, parts: list[str]) -> None:
        self._known.update((part, np.array(self._whole(part), np.uint32).tobytes()) for part in parts)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all rows one after another, number of tokens of every row); null counts as empty."""
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        cut = pc.replace_substring_regex(texts, f"([{_LETTER}])([{_MARK}])", rf"\1{_CUT}\2")
        cut = pc.replace_substring_regex(pc.replace_substring(cut, " ", f"{_CUT} "), r"\n+", rf"{_CUT}\0{_CUT}")
        parts = pc.split_pattern(cut, _CUT)
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        number, distinct = coded.indices.to_numpy(), coded.dictionary  # 32 bits are enough for a slice
        holds = lambda pattern: pc.match_substring_regex(distinct, pattern).to_numpy(zero_copy_only=False)
        good, feeds, blank = holds(_GOOD), holds(r"\A\n"), holds(r"\A(?: |\z)")
        bad = ~good[number]
        # line feeds are cut by what follows: a text's end or a blank would be another matter
        follows = np.append(blank[number[1:]], True)
        follows[bounds[1:] - 1] = True
        bad |= feeds[number] & follows
        odd = np.add.reduceat(bad, bounds[:-1], dtype=np.int64) > 0
        odd |= pc.match_substring_regex(texts, self._whole_only).to_numpy(zero_copy_only=False)
        if len(self._known) > KNOWN:
            self._known.clear()
        words = [word if fine else "" for word, fine in zip(distinct.to_pylist(), good.tolist())]
        self._known[""] = b""
        self._learn([word for word in words if word not in self._known])
        found = [self._known[word] for word in words]
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        lengths = sizes[number]
        total = np.cumsum(lengths)
        at = np.repeat((np.cumsum(sizes) - sizes)[number] - (total - lengths), lengths)
        at += np.arange(len(at))
        ids = flat[at]
        counts = np.diff(np.append(0, total)[bounds])
        return self._with_whole(texts, np.flatnonzero(odd), ids, counts) if odd.any() else (ids, counts)

    def _with_whole(self, texts, odd, ids, counts):
        rows = np.split(ids, np.cumsum(counts)[:-1])
        for row in odd:
            rows[row] = np.array(self._whole(texts[int(row)].as_py()), np.uint32)
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
