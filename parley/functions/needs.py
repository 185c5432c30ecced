"""What every match of a detector's pattern contains, so that texts without it need no full search."""

from .patterns import DETECTORS

#: By the number of the detector: a literal, or a pattern that is faster than the detector's own.
LITERALS = {0: "@", 5: "://", 6: "k_", 7: "AKIA"}
PATTERNS = {1: r"\d{3}", 2: r"\d{3}-", 3: r"\d(?:[ -]?\d){3}", 4: r"\d\.\d", 9: r"\d[/-]\d", 10: r"\s\d", 11: r"\s\d", 12: r"\d[- ][Yy]"}

LITERAL_OF = {DETECTORS[i][2]: v for i, v in LITERALS.items()}
PATTERN_OF = {DETECTORS[i][2]: v for i, v in PATTERNS.items()}
