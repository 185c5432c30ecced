"""Places, public figures and first names, all in lower case."""

# They must equal the service's for equal results. Cities stand under the region that takes their place.
CITIES = {
    "Ontario": ["toronto", "ottawa", "mississauga", "hamilton", "london"],
    "Quebec": ["montreal", "quebec city", "laval", "gatineau"],
    "British Columbia": ["vancouver", "victoria", "surrey", "burnaby"],
    "Alberta": ["calgary", "edmonton"],
    "Manitoba": ["winnipeg"],
    "Saskatchewan": ["saskatoon", "regina"],
    "Nova Scotia": ["halifax"],
    "Newfoundland and Labrador": ["st. john's"],
    "New Brunswick": ["fredericton"],
    "Prince Edward Island": ["charlottetown"],
    "New York": ["new york", "new york city", "buffalo"],
    "California": ["los angeles", "san francisco", "san diego", "san jose", "sacramento", "oakland"],
    "Illinois": ["chicago"],
    "Texas": ["houston", "dallas", "austin", "san antonio", "fort worth"],
    "Arizona": ["phoenix", "tucson"],
    "Pennsylvania": ["philadelphia", "pittsburgh"],
    "Ohio": ["columbus", "cleveland", "cincinnati"],
    "Indiana": ["indianapolis"],
    "North Carolina": ["charlotte", "raleigh"],
    "Washington": ["seattle", "spokane"],
    "Colorado": ["denver"],
    "Massachusetts": ["boston"],
    "Tennessee": ["nashville", "memphis"],
    "Michigan": ["detroit"],
    "Oregon": ["portland"],
    "Nevada": ["las vegas"],
    "Maryland": ["baltimore"],
    "Wisconsin": ["milwaukee"],
    "New Mexico": ["albuquerque"],
    "Missouri": ["kansas city", "st. louis"],
    "Georgia": ["atlanta"],
    "Florida": ["miami", "orlando", "tampa", "jacksonville"],
    "Louisiana": ["new orleans"],
    "Minnesota": ["minneapolis"],
    "Utah": ["salt lake city"],
    "Alaska": ["anchorage"],
    "Hawaii": ["honolulu"],
}
REGIONS = [
    "ontario", "quebec", "british columbia", "alberta", "manitoba", "saskatchewan", "nova scotia", "new brunswick", "newfoundland and labrador", "prince edward island", "yukon", "northwest territories", "nunavut",
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland",
    "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon",
    "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming",
]
COUNTRIES = [
    "canada", "united states", "usa", "america", "united states of america", "mexico", "france", "germany", "italy", "spain", "portugal", "united kingdom", "england", "scotland", "wales", "ireland", "japan", "china", "india", "brazil",
    "australia", "netherlands", "belgium", "switzerland", "austria", "sweden", "norway", "denmark", "finland", "poland", "russia", "ukraine", "turkey", "egypt", "south africa", "nigeria", "kenya", "argentina", "chile", "colombia",
    "peru", "south korea", "vietnam", "thailand", "philippines", "indonesia", "pakistan", "bangladesh", "israel", "saudi arabia", "greece",
]
#: Public figures and characters: their Wikidata items.
FIGURES = {
    "napoleon": "Q517", "napoleon bonaparte": "Q517", "albert einstein": "Q937", "michael jordan": "Q41421", "taylor swift": "Q26876", "barack obama": "Q76", "william shakespeare": "Q692", "marie curie": "Q7186",
    "isaac newton": "Q935", "abraham lincoln": "Q91", "winston churchill": "Q8016", "cleopatra": "Q635", "julius caesar": "Q1048", "leonardo da vinci": "Q762", "elon musk": "Q317521",
    "sherlock holmes": "Q4653", "harry potter": "Q3244512", "darth vader": "Q12206942", "batman": "Q2695156", "superman": "Q79015",
}
FIRST_NAMES = ["sarah", "john", "emma", "michael", "david", "maria", "james", "jennifer", "robert", "linda", "napoleon", "cleopatra", "batman", "superman"]
#: Words that start a sentence, not a name.
STARTERS = ["the", "a", "an", "i", "my", "we", "write", "tell", "how", "what", "when", "where", "why", "who", "is", "are", "can", "could", "please", "imagine", "suppose", "in", "for", "on", "at", "this", "that"]
CAPITALISED = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
YEAR = r"\b(?:1[89]\d{2}|20\d{2})\b"
