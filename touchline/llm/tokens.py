"""Token ids of a public byte-level vocabulary, with a cache of pieces of text."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_BLANKS = re.compile(r"[^\S \n]")
SPECIAL = "<|endoftext|>"
# the same two, for Arrow's expressions, whose white space is that of ASCII
WHOLE = (
    r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|"
    + re.escape(SPECIAL)
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def narrowest(path: str, end_id: int) -> str:
    """The numbers that hold each id of a vocabulary, in 2 bytes or 4."""
    from tokenizers import Tokenizer as Encoder

    most = max(end_id, *Encoder.from_file(path).get_vocab().values())
    return "<u2" if most < 1 << 16 else "<u4"


class Tokenizer(dict):
    """Ids of whole texts, as little-endian unsigned 32-bit numbers in bytes.

    The vocabulary never joins a blank with what stands before it, so a text
    falls into pieces (blanks, then other characters) with ids of their own. The
    ids of a piece are computed once; the cache is emptied at ``most`` pieces. Texts
    with other white space or a special token's string are encoded whole.
    """

    def __init__(self, path: str, most: int = 200_000):
        self.path, self.most, self._pieces, self._joined, self._whole = path, most, None, None, None

    def _whole_ids(self, text: str) -> bytes:
        if self._whole is None:
            from tokenizers import Tokenizer as Encoder

            self._whole = Encoder.from_file(self.path)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if self._pieces is None:
            self._pieces, self._joined = _same_vocabulary(self.path)
        if len(self) >= self.most:
            self.clear()
        value = self[piece] = np.array(self._pieces(piece), "<u4").tobytes()
        return value

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if OTHER_BLANKS.search(text) or SPECIAL in text:
            return self._whole_ids(text)
        return b"".join(map(self.__getitem__, PIECES.findall(text)))

    def _distinct(self, pieces: pa.Array) -> pa.Array:
        """Ids of each piece. Those from a blank to another character are encoded in one text, and told apart by their bytes."""
        inside = pc.match_substring_regex(pieces, r"^[ \n](?s:.*)[^ \n]$").to_numpy(zero_copy_only=False)
        known = pa.array([self[piece] for piece in pieces.filter(~inside).to_pylist()], pa.large_binary())
        joined = pieces.filter(inside)
        if not len(joined):
            return known
        if self._pieces is None:
            self._pieces, self._joined = _same_vocabulary(self.path)
        ends = np.cumsum(pc.binary_length(joined).to_numpy(), dtype=np.int64)
        text = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, ends[-1]])), joined.buffers()[2]])
        ids, places = self._joined(text[0].as_py())
        at = np.searchsorted(places, ends, "right")
        if not np.array_equal(places[at - 1], ends):
            raise ValueError("the vocabulary joins pieces of text")
        cuts = pa.py_buffer(4 * np.append(0, at).astype(np.int64))
        apart = pa.Array.from_buffers(pa.large_binary(), len(at), [None, cuts, pa.py_buffer(ids)])
        order = np.empty(len(pieces), np.int64)
        order[np.flatnonzero(~inside)] = np.arange(len(known))
        order[np.flatnonzero(inside)] = np.arange(len(known), len(pieces))
        return pa.concat_arrays([known, apart]).take(pa.array(order))

    def batch(self, texts: pa.Array, end_id: int, kind: str = "<u4") -> pa.Array:
        """``ids`` of each text (null: none) with ``end_id`` after them, as numbers of a kind; a piece is looked up once for all texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, WHOLE)
        long = [self._whole_ids(t) for t in texts.filter(whole).to_pylist()]
        whole = whole.to_numpy(zero_copy_only=False)
        if long:
            texts = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts)
        n, (_, offsets, data) = len(texts), texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(data or b"", "u1")[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        blank = (data == ord(" ")) | (data == ord("\n"))
        first = blank.copy()  # a piece begins with a blank after another character, or with its text
        first[1:] &= ~blank[:-1]
        first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(first)
        cuts = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, cuts, pa.py_buffer(data)]).dictionary_encode()
        known = self._distinct(pieces.dictionary)
        bounds = np.searchsorted(starts, offsets)
        # after its pieces a text has its whole ids, where it is encoded so, and the end
        extra = np.full(n + len(long), len(known))
        ends = np.cumsum(1 + whole)
        extra[ends[whole] - 2] = np.arange(len(known) + 1, len(known) + 1 + len(long))
        order = np.insert(pieces.indices.to_numpy(), np.repeat(bounds[1:], 1 + whole), extra)
        values = pa.concat_arrays([known, pa.array([np.array([end_id], "<u4").tobytes(), *long], pa.large_binary())])
        _, offsets, data = values.take(pa.array(order)).buffers()
        at = np.append(0, bounds[1:] + ends)
        ids = np.frombuffer(data or b"", "<u4").astype(kind, copy=False)
        offsets = (np.frombuffer(offsets, np.int64)[at] // 4 * ids.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


def _same_vocabulary(path: str):
    """The faster encoder of the same vocabulary, if its ranks lie beside the file.

    Two functions: the ids of a text, and with them where each ends in the text's bytes.
    """
    from pathlib import Path

    ranks = Path(path).with_suffix(".tiktoken")
    if not ranks.exists():
        from tokenizers import Tokenizer as Encoder

        encoder = Encoder.from_file(path)

        def found(text: str) -> tuple[np.ndarray, np.ndarray]:
            code = encoder.encode(text, add_special_tokens=False)
            size = np.cumsum([0, *(len(c.encode()) for c in text)])  # offsets count characters
            return np.array(code.ids, "<u4"), size[[end for _, end in code.offsets]]

        return lambda text: encoder.encode(text, add_special_tokens=False).ids, found
    import public_tokenizers
    import tiktoken

    lines = (line.split() for line in ranks.read_bytes().splitlines())
    table = {base64.b64decode(token): int(rank) for token, rank in lines}
    encoder = tiktoken.Encoding(
        "pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
    )
    size = np.zeros(max(table.values()) + 1, np.int64)
    size[list(table.values())] = [len(token) for token in table]

    def found(text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(encoder.encode_to_numpy(text), "<u4")
        return ids, np.cumsum(size[ids])

    return encoder.encode_ordinary, found


_SHARED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One tokenizer per worker process."""
    if path not in _SHARED:
        _SHARED[path] = Tokenizer(path)
    return _SHARED[path]
