"""Patterns and word lists. Written with ASCII word boundaries (\\b), which Spark gets spelled out."""

#: White space as JavaScript's \s has it.
WS = r"[\s\x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

#: \b for Java, whose own counts accented letters as word characters.
ASCII_B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# What each kind of span is, and how sure a match is. They must equal the service's for equal results.
DETECTORS = [
    ("EMAIL", 0.95, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("PHONE", 0.85, r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"),
    ("GOV_ID", 0.9, r"\b\d{3}-\d{2}-\d{4}\b"),
    ("ACCOUNT", 0.7, r"\b(?:\d[ -]?){13,19}\b"),
    ("IP", 0.9, r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"),
    ("URL", 0.95, r"(?i)\bhttps?://[^\s]+"),
    ("SECRET", 0.95, r"\b(?:sk|pk)_[A-Za-z0-9]{20,}\b"),
    ("SECRET", 0.95, r"\bAKIA[0-9A-Z]{16}\b"),
    ("SECRET", 0.9, r"(?i)\b(?:password|passcode|api key|secret key|private key|access token)\s+is\s+\S+"),
    ("DATE", 0.85, r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b"),
    ("DATE", 0.8, r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2}(?:,?\s+\d{4})?\b"),
    ("AGE", 0.9, r"(?i)\b(?:i'?m|i am)\s+(\d{1,2})\b"),
    ("AGE", 0.9, r"(?i)\b(\d{1,2})[- ]year[- ]old\b"),
    ("NORP", 0.8, r"(?i)\b(catholic|christian|muslim|jewish|hindu|buddhist|sikh|atheist|republican|democrat)\b"),
]
# Fixed values too, down to the end of this file: phrases, thresholds and prices must equal the service's for equal results.
THIRD_PARTY = r"(?i)\bmy\s+(?:mother|mom|father|dad|parent|sister|brother|sibling|son|daughter|child|kid|wife|husband|spouse|partner|girlfriend|boyfriend|fianc[ée]e?|friend|colleague|co-?worker|boss|manager|employee|neighbou?r|roommate|flatmate|classmate|teacher|student|doctor|therapist|lawyer|accountant|client|patient|landlord|tenant|aunt|uncle|cousin|niece|nephew|grand(?:mother|father|ma|pa)|in-law)\b"
SELF = r"(?i)\b(?:i|i'?m|i'?ve|i'?ll|i'?d|me|my|mine|myself|we|we'?re|we'?ve|us|our|ours)\b"
FICTION_STRONG = [
    r"(?i)\b(?:write|draft|compose|create|generate)\s+(?:me\s+)?(?:a|an|the)?\s*(?:short\s+)?(?:story|novel|screenplay|script|poem|fanfic|fan fiction|scene|chapter|dialogue|play)\b",
    r"(?i)\b(?:in|for)\s+my\s+(?:story|novel|screenplay|script|book|game|campaign|d&d|dnd)\b",
    r"(?i)\bfiction(?:al)?\s+(?:character|person|scenario|setting)\b",
]
FICTION_MEDIUM = r"(?i)\b(?:imagine|suppose|hypothetically|let'?s say|what if|pretend)\b"
FICTION_WEAK = r"(?i)\b(?:character|plot|protagonist|antagonist|narrative)\b"
OCCUPATION = r"(?i)\bi(?:'?m| am)\s+(?:a\s+|an\s+)?(?:\d{1,2}[- ]year[- ]old\s+)?(?:male\s+|female\s+)?(doctor|nurse|cardiologist|surgeon|teacher|professor|engineer|developer|lawyer|accountant|pilot|dentist|pharmacist|electrician|plumber|firefighter|police officer|scientist|architect|therapist|veterinarian|paramedic|librarian)\b"
FAMILY = r"(?i)\b(?:with|have|has|raising)\s+(?:one|two|three|four|five|\d+)\s+(?:kids?|children)\b"
GENDER = r"(?i)\bi(?:'?m| am)\s+(?:a\s+)?(?:\d{1,2}[- ]year[- ]old\s+)?(male|female|man|woman|non-binary)\b"
AGE_ADJECTIVE = r"(?i)\b(\d{1,2})[- ]year[- ]old\b"
SENTENCE = r"[^.!?\n]+[.!?]*"
PLACEHOLDER = r"\A\[[A-Z_0-9]+\]\z"
#: Thresholds and prices.
MIN_TOKENS, MAX_DENSITY, RECORD_QI, CONV_QI, CONV_QI_KEEP, CONV_QI_OUT = 10, 0.25, 3, 5, 4, 8
CENTS, ATTRITION = {"short": 1, "medium": 5, "long": 10}, 50
QI_ORDER = ["rare_attribute", "exact_age", "occupation", "employer", "family_structure", "education", "gender", "geo"]
