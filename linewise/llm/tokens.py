"""Token ids of whole texts by a public tokenizer, remembering the ids of chunks that a text can be cut into."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from linewise.llm.bpe_count import byte_letters

#: Chunks that a worker remembers, from one task to the next; those not met since half as many others came are forgotten.
REMEMBERED = 800_000
#: Bytes of text that are cut into chunks at once.
BLOCK_BYTES = 8 << 20
#: Letters that are one of UTF-8's first two-byte ones, stay single when lower-cased, and are the same in every normal form C.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: Chunks of such letters, and ones that the vocabulary's own pattern cuts in a known way.
_WORD, _EASY = re.compile(f" ?[{_LETTER}]+"), re.compile(f"[\n -~{_LETTER}]*")
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d|"
_LED_PIECES = re.compile(f"{_SHORT} ?[{_LETTER}]+| ?[0-9]+| ?[^\\s0-9{_LETTER}]+|\\s+")
_DROPPED_PIECES = re.compile(f"{_SHORT}[{_LETTER}]+|[0-9]|[^\\s0-9{_LETTER}]+")
#: White space other than space and line break: such texts are left whole.
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: Stands behind each text of a block; no UTF-8 has it.
_SEP = 0xFF
#: What a byte is in a block: 1 a space, 2 a line break, 3 other white space, 4 the separator, 0 anything else.
_KIND = bytes({0x20: 1, 0x0A: 2, _SEP: 4, **dict.fromkeys(b"\x09\x0b\x0c\x0d\x1c\x1d\x1e\x1f", 3)}.get(b, 0) for b in range(256))
#: For vocabularies that lower-case and drop white space.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\r", b"abcdefghijklmnopqrstuvwxyz   ")


def _chunk_starts(kind: np.ndarray) -> np.ndarray:
    """Where the chunks of a block start: a space that a word follows goes with it, a line break stands alone there, and
    what comes before that in a run of spaces and line breaks, or a run at a text's end, is one chunk. So are separators."""
    blank = (kind == 1) | (kind == 2)
    word = ~blank & (kind != 4)
    start = np.empty(len(kind), bool)
    start[0] = True
    start[1:] = blank[1:] & ~blank[:-1]
    start[:-1] |= blank[:-1] & word[1:]
    start[1:] |= word[1:] & ~word[:-1] & (kind[:-1] != 1)
    apart = np.flatnonzero(kind == 4)
    start[apart] = True
    start[apart[:-1] + 1] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids as the library gives them, without special tokens added.

    Two kinds of vocabulary cut a text at white space in a way that makes its chunks independent: byte-level ones where
    a space leads the word after it, and ones that lower-case, cut letters from marks and drop white space. Each chunk's
    ids are looked up or encoded by the library; a text with special strings or unusual white space, and any text for
    another kind of vocabulary, goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, normalizer = spec["pre_tokenizer"] or {}, spec["normalizer"]
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.led = pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and normalizer is None
        steps = [x["type"] for x in (normalizer or {}).get("normalizers", [])]
        cuts = [x["type"] for x in pre.get("pretokenizers", [])]
        self.dropped = steps == ["NFC", "Replace", "Lowercase"] and cuts == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["invert"]
        self.vocabulary = self.library.get_vocab_size()
        self.model = Tokenizer.from_file(path).model
        if resize := getattr(self.model, "_resize_cache", None):
            resize(0)  # what it gets is new
        self.letters = dict(enumerate(byte_letters()))
        self.space = self.letters[0x20]
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def forget(self) -> None:
        """Frees what has been remembered; the worker lives on."""
        self.known, self.before = {}, {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that the vocabulary's pattern doesn't cut: by its model, which sees letters that stand for bytes."""
        if not piece.isascii():
            piece = (piece.lower() if self.dropped else piece).encode().decode("latin-1").translate(self.letters)
        elif self.led:
            piece = piece.replace(" ", self.space) if piece[-1] > " " else piece.translate(self.letters)
        return array("I", [x.id for x in self.model.tokenize(piece)]).tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Chunks of ASCII and easy letters are cut as the vocabulary's pattern does; others go to the library whole."""
        known, before, others, dropped, of, is_word = self.known, self.before, [], self.dropped, self._piece, _WORD.fullmatch
        lead, cut = (b" ", _DROPPED_PIECES) if dropped else (b"", _LED_PIECES)
        for blob in new:
            chunk = blob.decode()
            if dropped:
                chunk = chunk.strip(" ")
            if is_word(chunk):
                known[blob] = of(chunk)
            elif _EASY.fullmatch(chunk):
                blobs = []
                for piece in cut.findall(chunk):
                    stored = lead + piece.encode()
                    ids = known.get(stored) or before.get(stored)
                    if ids is None:
                        ids = known[stored] = of(piece)
                    blobs.append(ids)
                known[blob] = b"".join(blobs)
            else:
                others.append((blob, chunk))
        for at in range(0, len(others), 20_000):
            some = others[at : at + 20_000]
            known.update(zip((x for x, _ in some), self._library([x for _, x in some])))

    def _ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each of `chunks`, which are distinct."""
        if len(self.known) > REMEMBERED // 2:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        found = list(map(known.get, chunks))
        at = [i for i, ids in enumerate(found) if ids is None]
        if before:
            known.update((chunks[i], before[chunks[i]]) for i in at if chunks[i] in before)
        self._learn([x for i in at if (x := chunks[i]) not in known])
        for i in at:
            found[i] = known[chunks[i]]
        return found

    def _is_whole(self, text: str) -> bool:
        if any(x in text for x in self.specials) or (self.dropped and "<|" in text):
            return True
        return self.led and not text.isascii() and _OTHER_SPACE.search(text) is not None

    def _block(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text, None for one that has to go to the library whole."""
        whole = [self._is_whole(text) for text in texts]
        cut = [b"" if w else text.encode() for text, w in zip(texts, whole)]
        ends = np.cumsum([len(x) + 1 for x in cut])
        joint = bytes([_SEP]).join([*cut, b""])
        if self.dropped:
            joint = joint.translate(_PLAIN)
        kind = np.frombuffer(joint.translate(_KIND), np.uint8)
        if self.led and (odd := np.flatnonzero(kind == 3)).size:
            for at in np.unique(np.searchsorted(ends, odd, side="right")).tolist():
                whole[at] = True
        starts = _chunk_starts(kind)
        offsets = np.append(starts, len(kind)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joint)]).dictionary_encode()
        index, bounds, distinct = coded.indices.to_numpy(), *coded.dictionary.buffers()[1:]
        bounds, distinct = np.frombuffer(bounds, np.int32)[: len(coded.dictionary) + 1].tolist(), distinct.to_pybytes()
        chunks = [distinct[a:b] for a, b in zip(bounds, bounds[1:])]
        sep = chunks.index(bytes([_SEP]))
        blobs = self._ids_of([*chunks[:sep], *chunks[sep + 1 :]])
        blobs.insert(sep, b"")
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        first = np.cumsum(size) - size
        sizes = size[index]
        stops = np.cumsum(sizes)
        place = np.repeat(first[index] - stops + sizes, sizes)
        place += np.arange(len(place))
        flat = np.frombuffer(b"".join(blobs), "<u4")[place]
        bounds = stops[index == sep].tolist()
        return [None if w else flat[a:b] for a, b, w in zip([0, *bounds], bounds, whole)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not (self.led or self.dropped):
            return [np.frombuffer(x, "<u4") for x in self._library(texts)]
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= BLOCK_BYTES:
                size, end = size + len(texts[end]), end + 1
            found = self._block(texts[at:end])
            whole = iter(self._library([x for x, ids in zip(texts[at:end], found) if ids is None]))
            out += [np.frombuffer(next(whole), "<u4") if ids is None else ids for ids in found]
            at = end
        return out


_encoders: dict[str, Encoder] = {}


def forget() -> None:
    """Frees what this worker's encoders have remembered."""
    for x in _encoders.values():
        x.forget()


def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
