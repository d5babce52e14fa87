"""Reading a file in blocks inside a task."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator
from itertools import chain

BLOCK = 4 << 20
_IN_STRING = re.compile(r'["\\]')
_OUTSIDE = re.compile(r'["{}]')
_BLANK = " \t\r\n"


def blocks_of(path: str, size: int = BLOCK) -> Iterator[bytes]:
    """The bytes of a file named by a Spark path, block by block."""
    if path.startswith("file:"):
        stream = open("/" + path[len("file:"):].lstrip("/"), "rb")
    else:
        from urllib.parse import quote

        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(quote(path, safe=":/@%"))
        stream = system.open_input_stream(inner)
    with stream:
        while block := stream.read(size):
            yield block


def json_elements(blocks: Iterable[bytes], name: str) -> Iterator[str]:
    """Texts of the objects of one JSON array, or of one object, from UTF-8 blocks.

    Only strings and braces are followed; what an object holds is left to the
    parser of the elements.  Work is linear in the file, memory is one element
    and one block.  Anything else than an array of objects or an object raises.
    """
    state, in_array, depth, in_string, skip = "start", False, 0, False, False
    kept: list[str] = []  # pieces of the object that is open
    decode = codecs.getincrementaldecoder("utf-8-sig")().decode
    for text in chain((decode(block) for block in blocks), (decode(b"", final) for final in (True,))):
        at = 0
        while at < len(text):
            if state != "inside":
                sign, at = text[at], at + 1
                if sign in _BLANK:
                    continue
                if sign == "{" and state in ("start", "first", "next"):
                    kept, depth, state = ["{"], 1, "inside"
                elif sign == "[" and state == "start":
                    in_array, state = True, "first"
                elif sign == "," and state == "after":
                    state = "next"
                elif sign == "]" and state in ("first", "after"):
                    state = "end"
                else:
                    raise ValueError(f"no array of objects: unexpected {sign!r} in {name}")
                continue
            begin = at
            while at < len(text) and depth:
                if skip:  # the sign after a backslash, which may be in the next block
                    at, skip = at + 1, False
                    continue
                hit = (_IN_STRING if in_string else _OUTSIDE).search(text, at)
                if hit is None:
                    at = len(text)
                    break
                sign, at = hit.group(), hit.end()
                if sign == "\\":
                    skip = True
                elif sign == '"':
                    in_string = not in_string
                else:
                    depth += 1 if sign == "{" else -1
            kept.append(text[begin:at])
            if depth == 0:
                yield "".join(kept)
                kept, state = [], "after" if in_array else "end"
    if state != "end":
        raise ValueError(f"the file ends early: {name}")
