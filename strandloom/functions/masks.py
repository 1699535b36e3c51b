"""Sampling patterns: parsing, geometry, and the stride tables of seed sampling."""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from functools import cached_property

# The named patterns, as weight-from-span.
PRESETS = {
    "12from18": "111010110100110111",
    "11from18": "111010010100110111",
    "8from14": "11001001010111",
    "9from15": "110110101000111",
    "10from16": "1101100011010111",
    "13from21": "111011011000110101011",
    "14from21": "111011100101100101111",
}
# Seed strides by sensitivity, as (longest read, stride); the last one holds for all longer reads.
STRIDES = {
    "high": ((36, 2), (50, 3), (75, 4), (None, 6)),
    "medium": ((36, 2), (50, 3), (75, 4), (99, 8), (None, 12)),
    "low": ((36, 2), (75, 4), (99, 10), (149, 14), (None, 18)),
    "fast": ((36, 2), (50, 3), (100, 4), (200, 8), (None, 10)),
}
MAX_SPAN, MAX_WEIGHT = 50, 15


@dataclass(frozen=True)
class Mask:
    """A 0/1 pattern; its ones are the sampled places."""

    pattern: str
    offsets: tuple[int, ...] = field(init=False)

    def __post_init__(self):
        if not self.pattern or set(self.pattern) - set("01") or "1" not in self.pattern:
            raise ValueError(f"no sampling pattern: {self.pattern!r}")
        if len(self.pattern) > MAX_SPAN or self.pattern.count("1") > MAX_WEIGHT:
            raise ValueError(f"a pattern spans {MAX_SPAN} places and samples {MAX_WEIGHT} at most")
        object.__setattr__(self, "offsets", tuple(i for i, c in enumerate(self.pattern) if c == "1"))

    @property
    def span(self) -> int:
        return len(self.pattern)

    @property
    def weight(self) -> int:
        return len(self.offsets)

    @cached_property
    def gains(self) -> tuple[int, ...]:
        """New places that the pattern samples when it stands s further on; s from 0, the full weight from the span on."""
        own = set(self.offsets)
        return tuple(len({o + s for o in own} - (own if s else set())) for s in range(self.span + 1))

    def gain(self, shift: int) -> int:
        return self.gains[min(shift, self.span)]

    def covered(self, places) -> int:
        """Places that the pattern samples when it stands at each of places."""
        return len({p + o for p in places for o in self.offsets})


def parse_mask(text: str) -> Mask:
    """A named pattern (12from18) or a literal one (1101); anything else is an error."""
    return Mask(PRESETS.get(text, text))


def random_mask(span: int, weight: int, seed: int = 0) -> Mask:
    """A pattern of a given span and weight whose places are drawn at random."""
    if not 0 < weight <= span:
        raise ValueError("weight must be from 1 to the span")
    picked = set(random.Random(seed).sample(range(span), weight))
    return Mask("".join("1" if i in picked else "0" for i in range(span)))


def stride(sensitivity: str, length: int) -> int:
    return next(s for most, s in STRIDES[sensitivity] if most is None or length <= most)
