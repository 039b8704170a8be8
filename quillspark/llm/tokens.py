"""Splitting texts into pre-tokens that a tokenizer never joins, and counting their pieces."""

from __future__ import annotations

import functools
import json
import os
import re

#: White space before a blank or a line feed; without it, those two always begin a new pre-token.
_RUN = re.compile(r"[\s\x1c-\x1f\x85][ \n]")
_CHUNK = re.compile(r"[ \n]?[^ \n]+|[ \n]")
_BOUNDARY = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def chunks(text: str) -> list[str]:
    """Split before each blank or line feed that follows something else than white space.

    The byte-level pattern never matches across such a place and looks back
    nowhere, so the tokens of the text are those of its chunks in turn.
    """
    if _RUN.search(text):
        return [c for c in _BOUNDARY.split(text) if c]
    return _CHUNK.findall(text)


class Counter_:
    """Token counts by the library that belongs to the vocabulary file's type."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.special: list[str] = []
        if path.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            self.counts = lambda texts: [len(x) for x in own.encode(texts, num_threads=1)] if texts else []
            self.split = lambda text: [text]
            return
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        self.special = [t.content for t in own.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        byte_level = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                      and not spec.get("normalizer"))
        self.counts = lambda texts: [len(e.ids) for e in own.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        # other kinds of pre-tokenizer: the whole text is one pre-token, which is always right
        self.split = self._chunks if byte_level else lambda text: [text]

    def _chunks(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return [text]
        return chunks(text)


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Counter_:
    """One for each Python worker and file."""
    return Counter_(path)


class Coder:
    """Token ids of byte-level BPE texts.

    The vocabulary is that of the ``tokenizers`` file; the ids come from
    ``tiktoken`` over the same ranks, which gives the same ids several times
    faster.  A text that holds a special string goes to ``tokenizers``, and so
    does one whose runs of white space are too long for ``tiktoken``'s pattern
    to look ahead over.
    """

    def __init__(self, path: str):
        import numpy as np
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        special = [t.content for t in own.get_added_tokens_decoder().values()]
        plain = _byte_of_letter()
        ranks = {bytes(plain[c] for c in piece): i for piece, i in own.get_vocab(with_added_tokens=False).items()
                 if piece not in special}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def ids(text: str) -> bytes:
            """Little-endian unsigned 32-bit ids."""
            if not any(s in text for s in special):
                try:
                    return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
                except ValueError:  # the pattern's stack is bounded
                    pass
            return np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        self.ids = ids


def _byte_of_letter() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One for each Python worker and file."""
    return Coder(path)
