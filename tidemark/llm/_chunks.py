"""Where a byte-level BPE text may be cut without changing a token.

A token of the byte-level pre-tokeniser never holds a non-space followed by a space, so a blank that stands between
two non-spaces always begins a new unit, which is encoded without regard to its neighbours.
"""

from __future__ import annotations

import re

#: A blank between white space (or before the end) belongs to a longer run of white space.
_RUN = re.compile(r"\s \s|\s \Z")
#: White space but the blank, each with a blank behind it: without one of these or two blanks there is no such run.
_HINTS = ["  ", *(c + " " for c in map(chr, range(0x3001)) if c.isspace() and c != " ")]
BLOCK = 1 << 16


def blocks(text: str, size: int = BLOCK):
    """Pieces of about `size` characters, each cut before a blank between two non-spaces; a text without such a place stays whole."""
    at, n = 0, len(text)
    while n - at > size:
        cut = at + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= n:
                cut = n
                break
            if not text[cut - 1].isspace() and not text[cut + 1].isspace():
                break
            cut += 1
        yield text[at:cut]
        at = cut
    if at < n:
        yield text[at:]


def has_runs(block: str) -> bool:
    """Whether a blank of the block stands within a longer run of white space."""
    return any(h in block for h in _HINTS) and bool(_RUN.search(block))


def units(block: str) -> list[str]:
    """The block's independent units: the first as it stands, the others without the blank that begins them; [block] if runs of white space forbid this."""
    return [block] if has_runs(block) else block.split(" ")
