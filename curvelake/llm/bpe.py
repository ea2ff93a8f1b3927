"""What the token counter and the merge-dropout encoder share: a SentencePiece BPE model by its pieces.

The model has no normalisation but a space in front and spaces as U+2581.
No piece holds U+2581 after another character, and a line feed has no piece,
so a text's encoding is the concatenation of its pre-tokens' encodings.
"""

from __future__ import annotations

import re
import threading

SPACE = "▁"
#: A run of spaces with what follows it up to the next space or line feed; a line feed; or what follows a line feed.
PRETOKEN = re.compile(r"▁+[^▁\n]*|\n|[^▁\n]+")
#: A pre-token beyond this many characters is never cached.
CACHED_CHARS = 48

_lock = threading.Lock()
_loaded: dict[str, object] = {}


def processor(path: str):
    """The model's processor, loaded once in a process."""
    with _lock:
        if path not in _loaded:
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        return _loaded[path]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public vocabulary files are installed; workers resolve it for themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


def splittable(path: str) -> bool:
    """Whether the facts of the module's head hold for this model."""
    sp = processor(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    inner = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
    probe = "a  bé ﬁ é c"
    return not inner and sp.normalize(probe) == SPACE + probe.replace(" ", SPACE)


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text, the space in front included; an empty text has none."""
    return PRETOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Recent(dict):
    """A bounded cache of ``make(piece)`` that keeps what is in use.

    It has two generations of at most ``most`` entries: when the young one is
    full it becomes the old one, from which what is asked for moves back.
    Pieces of more than ``CACHED_CHARS`` characters are made each time.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str):
        got = self.old.get(piece)
        if got is None:
            got = self.make(piece)
            if len(piece) > CACHED_CHARS:
                return got
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = got
        return got
