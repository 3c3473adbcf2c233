"""Script and language of a text, from its own characters and function words."""

from __future__ import annotations

import re

import numpy as np

# Frequent function words of the four Latin-script languages of the data.
FUNCTION_WORDS = {
    "en": "the of and to in a is was were for with by from that it at on which who what how when where before after not be been had has are no".split(),
    "de": "der die das und ist war in im am von mit zu den dem des ein eine einer nicht wurde wurden bei aus auf für wer wie welches welchem man hat sich vor nach es gegen über wird".split(),
    "fr": "le la les et des du une un est a de en par pour dans chez qui que quoi quel quelle où au aux il elle sur avec avant après ne pas plus été contre cette".split(),
    "es": "el la los las y de del un una es en por para con que qué quién cuántos dónde se al no su fue fueron más antes contra lo como cerca".split(),
}
LANGS = tuple(FUNCTION_WORDS)
_WEIGHT = {w: {k: 1.0 / sum(w in v for v in FUNCTION_WORDS.values()) for k, v in FUNCTION_WORDS.items() if w in v} for ws in FUNCTION_WORDS.values() for w in ws}
_WORD = re.compile(r"[^\W\d_]+")
#: Code blocks of 128 code points that belong to a script (fixed values): first and last block.
_BLOCKS = {"th": ((0x0E00, 0x0E7F),), "ja": ((0x3000, 0x30FF),), "zh": ((0x4E00, 0x9FFF),), "hi": ((0x0900, 0x097F),), "ar": ((0x0600, 0x06FF),), "ru": ((0x0400, 0x04FF),), "latin": ((0x0080, 0x027F),)}
_NAMES = (*_BLOCKS, "none")
_TABLE = np.full(0x110000 >> 7, len(_NAMES) - 1, np.uint8)
for _i, _n in enumerate(_BLOCKS):
    for _a, _z in _BLOCKS[_n]:
        _TABLE[_a >> 7 : (_z >> 7) + 1] = _i
_ASCII = re.compile("[A-Za-z]")
_KANA = re.compile("[\u3041-\u30ff]")


def script(text: str) -> str | None:
    """Language of a non-Latin script that carries the text, 'latin', or None without letters.

    Names in Latin letters occur in every script, so a fifth of the letters is enough.
    """
    if text.isascii():
        return "latin" if _ASCII.search(text) else None
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(_TABLE[code >> 7], minlength=len(_NAMES))
    n[_NAMES.index("latin")] += np.count_nonzero((code < 128) & ((code | 32) >= 97) & ((code | 32) <= 122))
    got = dict(zip(_NAMES, n.tolist()))
    latin = got.pop("latin")
    got.pop("none")
    if got["ja"] and _KANA.search(text):
        got["ja"] += got["zh"]
    else:
        got["ja"] = 0
    best = max(got, key=got.get)
    if not got[best]:
        return "latin" if latin else None
    return best if got[best] * 4 >= latin else "latin"


def scores(text: str) -> dict[str, float]:
    """Weight of the function words of each Latin-script language."""
    out = dict.fromkeys(LANGS, 0.0)
    for w in _WORD.findall(text.lower()):
        for k, x in _WEIGHT.get(w, {}).items():
            out[k] += x
    return out


def detect(text: str) -> str | None:
    """Language code, or None where there is no evidence."""
    s = script(text)
    if s != "latin":
        return s
    got = scores(text)
    a, b = sorted(got.values())[-1:-3:-1]
    return max(got, key=got.get) if a > b else None
