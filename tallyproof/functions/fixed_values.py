"""Vocabularies, labels, bins, formats and text patterns.

Results only match when these are exactly as published, so they are kept here as plain text and
in their natural order. Nothing in this module is logic.
"""

# --- identifiers and links -------------------------------------------------------------------
STUDY_ID_PATTERN = r"^NCT[0-9]{8}$"
STUDY_URL_FORMAT = "https://clinicaltrials.gov/study/%s"

# --- phases ----------------------------------------------------------------------------------
PHASE_ORDER = ["EARLY_PHASE1", "PHASE1", "PHASE2", "PHASE3", "PHASE4", "NA"]
PHASE_LABELS = {
    "EARLY_PHASE1": "Early Phase 1",
    "PHASE1": "Phase 1",
    "PHASE2": "Phase 2",
    "PHASE3": "Phase 3",
    "PHASE4": "Phase 4",
    "NA": "Not Applicable",
}
PHASE_CODES = {0: "EARLY_PHASE1", 1: "PHASE1", 2: "PHASE2", 3: "PHASE3", 4: "PHASE4"}

# --- enrollment bins, half open --------------------------------------------------------------
ENROLLMENT_BINS = [
    (0, 10, "0-9"),
    (10, 50, "10-49"),
    (50, 100, "50-99"),
    (100, 500, "100-499"),
    (500, 1000, "500-999"),
    (1000, None, "1000+"),
]

# --- report caps -----------------------------------------------------------------------------
TOP_N = {"sponsor": 15, "country": 20, "intervention_type": 15}
UNDATED_ORDER = 9999
MIN_EDGE_WEIGHT = 2
CANDIDATE_POOL = 120
MIN_MATCH_SCORE = 11.0
DEFAULT_CITATIONS = 3
MAX_CITATIONS = 20
TITLE_CLIP = 160

# --- interventions ---------------------------------------------------------------------------
DRUG_TYPES = ["DRUG", "BIOLOGICAL", "COMBINATION_PRODUCT"]
RESOLVABLE_TYPES = ["DRUG", "BIOLOGICAL"]
CONTROL_NAMES = [
    "placebo",
    "saline",
    "normal saline",
    "standard of care",
    "best supportive care",
    "matching placebo",
    "placebos",
    "vehicle",
    "no intervention",
]
CONTROL_TOKENS = ["placebo", "saline", "vehicle"]

PARENTHETICAL_PATTERN = r"\([^)]*\)"
DOSAGE_PATTERN = (
    r"(?iU)(?=\d)\b\d+(?:\.\d+)?\s*"
    r"(?:mcg|mg|kg|ml|iu|units?|g|l|%)"
    r"(?:\s*/\s*(?:kg|m2|m\^2|day|dose|hour|hr|week|wk|min|body|bsa|l))*"
    r"(?![a-z0-9])"
)
_ROUTES = (
    r"iv|im|sc|po|oral(ly)?|intravenous(ly)?|subcutaneous(ly)?|"
    r"injection|infusion|tablets?|capsules?|solution"
)
ROUTE_PATTERN = rf"(?iU)\b({_ROUTES})\b"
PUNCTUATION_PATTERN = r"(?U)[^a-z0-9\s\-+]"
#: ASCII words, one space between them, that none of the patterns above changes: no word begins with a
#: digit, as a dose does, and none is a route.
PLAIN_NAME_PATTERN = rf"^(?:(?!(?:{_ROUTES})(?![a-z0-9]))[a-z][a-z0-9]*+(?: (?=[a-z])|\z))+\z"

# --- single-agent names ----------------------------------------------------------------------
CONNECTIVE_PATTERN = r"(?U)\s(?:and|or|with|plus|versus|vs)\s|[+/,]"
COMPARATOR_PATTERN = r"(?U)\b(placebo|comparator|matching|vehicle|sham)\b"
RESEARCH_CODE_PATTERN = r"(?U)^[a-z]{1,4}[\s-]?\d{3,}[a-z]?$"
QUALIFIER_TOKENS = [
    "nab", "albumin", "bound", "pegylated", "peg", "liposomal", "liposome", "hydrochloride", "hcl",
    "sodium", "sulfate", "sulphate", "acetate", "citrate", "tartrate", "phosphate", "mesylate",
    "maleate", "succinate", "besylate", "fumarate", "dihydrate", "monohydrate", "calcium",
    "potassium", "magnesium", "injection", "injectable", "product", "concentrate", "conjugate",
    "recombinant", "human", "humanized", "biosimilar", "chemotherapy", "therapy", "monotherapy",
    "arm", "group", "drug", "agent", "acid", "free", "base", "alfa", "beta", "gamma", "vitamin",
    "solution", "suspension", "extended", "release",
]

# --- phases and years in text ----------------------------------------------------------------
PHASE_SEPARATOR = r"[\s:\-\u2010-\u2015]*"
EARLY_PHASE_PATTERN = rf"(?iU)\bearly{PHASE_SEPARATOR}phases?{PHASE_SEPARATOR}1\b"
PHASE_LIST_PATTERN = (
    rf"(?iU)\bphases?{PHASE_SEPARATOR}"
    r"((?:(?:[1-4]|iv|iii|ii|i)\b[\s]*(?:[/,&+-]|or|and|to)?[\s]*)+)"
)
PHASE_TOKEN_PATTERN = r"(?iU)\b([1-4]|iv|iii|ii|i)\b"
ROMAN_PHASES = {"i": 1, "ii": 2, "iii": 3, "iv": 4}

YEAR = r"(19[89]\d|20[0-3]\d)"
YEAR_PATTERN = rf"\b{YEAR}\b"
YEAR_SPAN_PATTERN = (
    rf"(?iU)\b(?:between\s+)?{YEAR}\s*(?:-|--|\u2013|\u2014|to|and|through|until|till)\s*{YEAR}\b"
)
YEAR_FROM_PATTERN = (
    r"(?iU)\b(?:since|from|starting(?:\s+in)?|beginning(?:\s+in)?|onwards?\s+from)\s+" + YEAR + r"\b"
)
YEAR_AFTER_PATTERN = rf"(?iU)\b(?:after|later\s+than)\s+{YEAR}\b"
YEAR_UNTIL_PATTERN = rf"(?iU)\b(?:until|till|through|up\s+to)\s+{YEAR}\b"
YEAR_BY_PATTERN = rf"(?iU)\b(?:(\w+)\s+)?by\s+{YEAR}\b"
YEAR_BEFORE_PATTERN = rf"(?iU)\b(?:before|prior\s+to|earlier\s+than)\s+{YEAR}\b"
AGENT_VERBS = [
    "sponsored", "funded", "run", "led", "conducted", "managed", "made", "produced", "developed",
    "designed", "owned", "operated", "supported", "approved", "cleared", "authorised", "authorized",
    "filed", "submitted", "published", "written", "reviewed", "grouped", "split", "broken",
    "divided", "ordered", "sorted", "organised", "organized", "ranked", "coloured", "colored",
    "segmented", "faceted",
]

# --- statuses in text ------------------------------------------------------------------------
STATUS_VOCABULARY = {
    "NOT_YET_RECRUITING": ["not yet recruiting", "not-yet-recruiting", "upcoming"],
    "ACTIVE_NOT_RECRUITING": [
        "active not recruiting",
        "active, not recruiting",
        "closed to enrollment",
        "closed to enrolment",
    ],
    "ENROLLING_BY_INVITATION": ["enrolling by invitation"],
    "NO_LONGER_AVAILABLE": ["no longer available"],
    "RECRUITING": ["recruiting", "enrolling", "actively enrolling"],
    "COMPLETED": ["completed", "finished", "concluded"],
    "TERMINATED": ["terminated", "halted", "stopped early"],
    "SUSPENDED": ["suspended", "paused", "on hold"],
    "WITHDRAWN": ["withdrawn"],
    "AVAILABLE": ["expanded access", "available for expanded access"],
    "UNKNOWN": ["unknown status"],
}
NEGATION_CUES = [
    "not",
    "non",
    "n't",
    "no longer",
    "never",
    "except",
    "excluding",
    "other than",
    "without",
    "stopped",
    "ceased",
    "halted",
    "paused",
    "suspended",
    "withdrawn",
    "neither",
    "nor",
]
LIST_CUES = ["except", "excluding", "other than", "without", "neither", "nor"]
LIST_COORDINATORS = ["and", "or", "nor"]
LIST_FILLER = [
    "trials", "trial", "studies", "study", "ones", "those", "yet", "currently", "still", "the", "a",
    "an", "is", "are", "that", "which", "was", "were",
]
CLAUSE_WORDS = ["and", "or", "but", "plus", "also"]
HYPHENS = "-\u2010\u2011\u2012\u2013\u2014\u2015"

# --- axis, graph kind and population words in text -------------------------------------------
AXIS_WORDS = {
    "phase": ["phase", "phases"],
    "sponsor": ["sponsor", "sponsors"],
    "country": ["country", "countries", "geography", "geographic"],
    "status": ["status", "statuses"],
    "intervention_type": ["intervention type", "intervention types"],
    "start_year": ["year", "yearly", "annually", "over time", "trend"],
    "enrollment_bucket": [
        "enrollment",
        "enrolment",
        "enrollment size",
        "sample size",
        "participants",
    ],
}
GRAPH_KIND_WORDS = {
    "sponsor_drug": [
        "sponsors and drugs",
        "sponsor and drug",
        "drugs and sponsors",
        "sponsor-to-drug",
        "sponsor to drug",
        "sponsor-drug",
        "sponsor drug",
        "sponsor network",
        "which sponsors",
        "between sponsors and drugs",
    ],
    "drug_drug": [
        "co-occur",
        "cooccur",
        "co-occurrence",
        "cooccurrence",
        "drug co-occurrence",
        "combination",
        "combination therapy",
        "combined with",
        "studied together",
        "used together",
        "drug-drug",
        "drug drug",
    ],
}
WHOLE_REGISTRY_PATTERN = (
    r"(?iU)\b(?:"
    r"all\s+(?:clinical\s+)?(?:trials|studies)"
    r"|every\s+(?:clinical\s+)?(?:trial|study)"
    r"|the\s+(?:whole|entire|full)\s+(?:registry|database)"
    r"|(?:across|in|throughout)\s+the\s+registry"
    r"|(?:entire|whole|full)\s+clinicaltrials\.gov(?:\s+registry)?"
    r"|clinicaltrials\.gov\s+(?:as\s+a\s+whole|overall)"
    r")\b"
)

# --- name grounding --------------------------------------------------------------------------
MIN_FUZZY_LENGTH = 6
FUZZY_THRESHOLD = 0.87
