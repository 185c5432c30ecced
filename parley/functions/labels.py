"""Labels of external detectors, kinds of spans and what becomes of them."""

# Fixed values, down to the end of this file: they must equal the service's for equal results.
#: External labels and the kinds that they are here; any other label stays as it is, and its spans are redacted.
LABELS = {
    "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "US_SSN": "GOV_ID", "US_ITIN": "GOV_ID", "US_PASSPORT": "GOV_ID", "US_DRIVER_LICENSE": "GOV_ID", "CREDIT_CARD": "ACCOUNT", "IBAN_CODE": "ACCOUNT", "US_BANK_NUMBER": "ACCOUNT",
    "CRYPTO": "ACCOUNT", "IP_ADDRESS": "IP", "URL": "URL", "MEDICAL_LICENSE": "MEDICAL_LICENSE", "PERSON": "PERSON", "LOCATION": "GPE", "DATE_TIME": "DATE", "NRP": "NORP", "ORGANIZATION": "ORG",
}
#: What takes an identifier's place.
PLACEHOLDERS = {"EMAIL": "EMAIL", "PHONE": "PHONE", "GOV_ID": "GOV_ID", "ACCOUNT": "ACCOUNT", "IP": "IP", "URL": "URL", "HANDLE": "HANDLE", "POSTAL": "POSTAL", "GEO_COORD": "GEO", "ADDRESS": "LOCATION", "MEDICAL_LICENSE": "ID"}
BENIGN = ("MONEY", "QUANTITY", "CARDINAL", "ORDINAL", "PERCENT", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE", "PRODUCT", "TIME")
EMPLOYER = r"(?i)\b(?:i work (?:at|for)|my (?:company|employer|firm|startup)|i(?:'m| am) (?:employed (?:at|by)|working at))\b"
#: How sure a span has to be: names are redacted, places and dates generalised, memberships suppress their sentence or exclude.
SURE = {"person": 0.3, "generalise": 0.4, "suppress": 0.35, "exclude": 0.75}
