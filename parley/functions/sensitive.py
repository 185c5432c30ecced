"""Sensitive categories: what excludes (E) and what only flags (F), as keywords and patterns."""

# They must equal the service's for equal results.
CATEGORIES = {
    "health": {
        "exclude": ["self-harm", "selfharm", "suicidal", "suicide attempt", "overdosed"],
        "exclude_patterns": [
            r"(?i)\b(?:i (?:was|am|got|have|had)|i'?ve been|my)\s+(?:\w+\s+){0,2}(?:diagnos\w*|prescrib\w*|prescription|symptom\w*|medication|meds|therapist|psychiatrist|psychologist|condition|illness|disease|disorder|syndrome|cancer|tumou?r|diabet\w*|asthma|epilep\w*|hiv|aids|hepatitis|depress\w*|anxiety|bipolar|schizophren\w*|ptsd|adhd|ocd|anorexi\w*|bulimi\w*|addiction|rehab|chemo\w*|surgery|biopsy|treatment)\b",
            r"(?i)\b(?:i'?m|i am|my (?:wife|partner|girlfriend|daughter|sister))\s+(?:\w+\s+){0,2}pregnant\b",
            r"(?i)\bmy (?:pregnancy|miscarriage|abortion|fertility|ivf)\b",
            r"(?i)\bmy (?:mother|father|mom|dad|sister|brother|son|daughter|wife|husband|partner|friend|colleague|coworker)\b[^.!?]{0,40}\b(?:diagnos\w*|cancer|depress\w*|anxiety|illness|disease|surgery|therapy|medication)\b",
            r"(?i)\b(?:has|gets|develops|suffers from|diagnosed with)\s+(?:\w+\s+)?(?:cancer|depression|anxiety|diabetes|schizophrenia|ptsd|hiv|aids|epilepsy)\b",
        ],
        "flag": [
            "treatment", "therapy", "therapist", "clinic", "hospital", "surgery", "disorder", "syndrome", "symptom", "symptoms", "diagnosis", "diagnosed", "medication", "dose", "dosage", "prescription", "vaccine", "immunization",
            "cancer", "tumor", "tumour", "diabetes", "asthma", "epilepsy", "hiv", "aids", "std", "sti", "hepatitis", "depression", "anxiety", "bipolar", "schizophrenia", "ptsd", "adhd", "ocd", "eating disorder", "anorexia", "bulimia",
            "pregnant", "pregnancy", "miscarriage", "abortion", "fertility", "ivf", "contraception", "chronic illness", "disability", "chemotherapy", "radiation", "biopsy", "mri", "ultrasound", "emergency room", "icu", "addiction", "rehab",
            "overdose", "mental health", "doctor", "nurse", "patient",
        ],
        "flag_patterns": [r"(?i)\b\d+\s?(?:mg|mcg|ml)\b"],
    },
    "children": {
        "exclude_patterns": [r"(?i)\bi(?:'?m| am)\s*1[0-7]\b", r"(?i)\bi(?:'?m| am)\s+(?:a\s+)?(?:minor|underage)\b", r"(?i)\bmy (?:son|daughter|kid|child)\s+is\s+\d{1,2}\b", r"(?i)\bin\s+\d{1,2}(?:st|nd|rd|th)\s+grade\b"],
        "flag": ["my son", "my daughter", "my kid", "my child", "my baby", "toddler", "kindergarten", "preschool", "elementary school", "middle school", "high school", "teenager"],
    },
    "biometric": {
        "exclude_patterns": [r"(?i)\bmy\s+(?:fingerprint|thumbprint|faceprint|face scan|retina|retinal scan|iris scan|voiceprint|palm print|biometrics?)\b", r"(?i)\bi\s+(?:scanned|registered|enrolled)\s+my\s+(?:face|fingerprint|iris|retina|voice)\b"],
        "flag": ["fingerprint", "thumbprint", "faceprint", "face scan", "facial recognition", "face id", "retina", "retinal scan", "iris scan", "voiceprint", "voice recognition", "biometric", "palm print", "hand geometry", "gait analysis"],
    },
    "sexual_orientation_sex_life": {
        "exclude": ["my sexual orientation", "my sex life", "i am gay", "i'm gay", "i am a lesbian", "i'm a lesbian", "i am bisexual", "i'm bisexual", "i am asexual", "i'm asexual", "i am transgender", "i'm transgender", "i am trans", "i'm trans"],
        "flag": ["sexually active", "sexual orientation", "lgbtq"],
    },
    "race_ethnicity": {
        "exclude": ["my ethnicity", "my race is", "my heritage is", "my ancestry is"],
        "exclude_patterns": [r"(?i)\bas an?\s+(?:african[- ]american|black|white|asian|hispanic|latino|latina|latinx|indigenous|native american|arab|jewish|middle eastern)\s+(?:man|woman|person|guy|girl|american|canadian|immigrant)\b"],
        "flag": ["ethnicity", "my background", "my culture"],
    },
    "religion": {
        "exclude": ["my religion", "my faith is", "my church", "my mosque", "my synagogue", "my temple", "i pray to"],
        "exclude_patterns": [r"(?i)\bi(?:'?m| am)\s+(?:a\s+)?(?:practi[cs]ing\s+|observant\s+)?(?:christian|catholic|muslim|jewish|hindu|buddhist|sikh|atheist|agnostic|mormon|evangelical|orthodox)\b"],
        "flag": ["religion", "faith", "church", "mosque", "synagogue", "temple", "prayer"],
    },
    "political_opinion": {
        "exclude": ["my political views", "my political opinion", "i voted for", "my party is"],
        "exclude_patterns": [r"(?i)\bi(?:'?m| am)\s+(?:a\s+)?(?:republican|democrat|conservative|liberal|progressive|socialist|libertarian|communist|anarchist)\b"],
        "flag": ["politics", "election", "political party", "voted"],
    },
    "trade_union": {
        "exclude": ["my union", "i am a union member", "i'm a union member", "my shop steward"],
        "flag": ["union member", "shop steward", "collective bargaining", "labor union", "labour union", "trade union"],
    },
    "genetic": {
        "exclude": ["my dna", "my genome", "my genetic test", "my dna test", "my 23andme", "my ancestry results"],
        "exclude_patterns": [r"(?i)\bi\s+(?:took|did|got)\s+(?:an?\s+)?(?:dna|genetic|ancestry)\s+test\b"],
        "flag": ["dna test", "genetic test", "genetic testing", "genome", "hereditary", "23andme", "ancestrydna", "genetic marker", "genetic predisposition", "brca"],
    },
    "precise_geolocation": {"flag": ["i live at", "my address is", "my home address", "my neighbourhood", "my neighborhood"]},
    "live_secret": {
        "exclude": ["seed phrase", "recovery phrase", "mnemonic phrase"],
        "exclude_patterns": [r"(?i)\b(?:my |the )?(?:password|passcode|pin|api key|secret key|private key|access token|auth token)\s+is\b", r"\b(?:sk|pk)_[A-Za-z0-9]{20,}\b", r"\bAKIA[0-9A-Z]{16}\b"],
        "flag": ["password", "passcode", "pin number", "routing number", "account number", "cvv", "security code", "api key", "secret key", "private key", "social security number", "credit card number", "access token"],
    },
}


def patterns(category: str, tier: str) -> list[str]:
    """The patterns of a tier; its keywords are one of them, between characters that are no ASCII letters or digits."""
    rule = CATEGORIES[category]
    words = "|".join(w.replace("-", r"\-").replace(" ", r"\s+") for w in rule.get(tier, ()))
    return ([rf"(?i)(?:^|[^A-Za-z0-9])(?:{words})(?:$|[^A-Za-z0-9])"] if words else []) + rule.get(f"{tier}_patterns", [])
