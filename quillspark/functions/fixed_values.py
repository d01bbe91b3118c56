"""Lookup tables and constants that results depend on."""

# Abbreviation signs and their expansions, in the order of replacement.
ABBREVIATIONS = {"q~": "que", "p~": "pre", "ꝑ": "per", "ꝗ": "qui", "ꝓ": "pro", "⁊": "et", "ẜ": "ser", "ꝫ": "us"}

# Vowels with a nasal tilde.
TILDES = {"ã": "an", "ẽ": "en", "ĩ": "in", "õ": "on", "ũ": "un", "Ã": "An", "Ẽ": "En", "Ĩ": "In", "Õ": "On", "Ũ": "Un"}

# Signs that count as unresolved abbreviations.
ABBREVIATION_SIGNS = "~ꝑꝗꝫꝓẜ⁊ↄ"

# Words that confidence-guided correction accepts.
CORRECTION_LEXICON = (
    "romanz", "comence", "engleterre", "brut", "gent", "tindrent", "normant", "vindrent", "livres", "devise", "que", "qui", "roi",
    "comte", "ci", "li", "de", "sa", "e", "et", "la", "le", "les",
)

# Confidence below which a character or line needs review, and its replacement options.
REVIEW_THRESHOLD = 0.70
CANDIDATE_OPTIONS = ("a", "e", "o")

# Entity types in the order of label ids; the ignored label id.
ENTITY_TYPES = ("PER", "LOC", "DATE", "ORG", "TITLE")
IGNORED_LABEL = -100

# Entity lexicons.
PERSONS = ("charles", "guillaume", "brut", "arthur", "wace", "marie", "philippe", "louis", "henri", "richard")
PLACES = ("france", "engleterre", "angleterre", "normandie", "paris", "rome", "bretagne", "londres")
TITLES = ("roi", "reine", "comte", "comtesse", "évêque", "duc", "empereur", "seigneur", "dame")
ORGANISATIONS = ("église", "abbaye", "royaume", "parlement")
DATE_WORDS = ("mil", "cent", "ans", "an", "jour", "mois")

# Verbs that state a relation.
RELATION_VERBS = {"tint": "TIENT", "tindrent": "TIENT", "prist": "PREND", "prindrent": "PREND", "conquist": "CONQUIERT", "vint": "VIENT_A", "regna": "REGNE_SUR", "fu": "EST"}

# Function words with part of speech and lemma.
FUNCTION_WORDS = {
    "li": ("DET", "li"), "le": ("DET", "le"), "la": ("DET", "la"), "les": ("DET", "le"), "un": ("DET", "un"), "une": ("DET", "un"),
    "sa": ("DET", "son"), "son": ("DET", "son"), "ses": ("DET", "son"),
    "de": ("ADP", "de"), "a": ("ADP", "a"), "en": ("ADP", "en"), "par": ("ADP", "par"), "por": ("ADP", "por"), "sur": ("ADP", "sur"),
    "e": ("CCONJ", "et"), "et": ("CCONJ", "et"), "que": ("SCONJ", "que"), "qui": ("PRON", "qui"), "ne": ("ADV", "ne"),
    "il": ("PRON", "il"), "ele": ("PRON", "ele"), "je": ("PRON", "je"), "ci": ("ADV", "ci"), "ainz": ("ADV", "ainz"),
}

# Verb forms and their lemmas.
VERBS = {
    "vint": "venir", "vindrent": "venir", "tint": "tenir", "tindrent": "tenir", "comence": "comencier", "fu": "estre",
    "furent": "estre", "ot": "avoir", "orent": "avoir", "dist": "dire", "fist": "faire", "prist": "prendre",
}

# TEI elements of entity types; any other type is "name".
TEI_TAGS = {"PER": "persName", "LOC": "placeName", "DATE": "date", "ORG": "orgName", "TITLE": "roleName"}

# Header texts of TEI and PAGE documents, where a caller gives no others.
TEI_PUBLICATION = "Produit par une transcription automatique."
TEI_SOURCE = "Transcription automatique de manuscrit médiéval."
PAGE_CREATOR = "Transcription automatique"

# Namespaces.
TEI_NAMESPACE = "http://www.tei-c.org/ns/1.0"
PAGE_NAMESPACE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"
PAGE_NAMESPACE_2013 = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"
ALTO_NAMESPACE = "http://www.loc.gov/standards/alto/ns-v4#"
ALTO_NAMESPACE_V2 = "http://www.loc.gov/standards/alto/ns-v2#"

# Error-rate targets.
CER_TARGET, CER_EXCELLENT, WER_TARGET = 0.15, 0.08, 0.25

# Start, least plateau, plateau without training lines and its fall a line, decay a epoch, noise and floor of simulated curves.
CURVE_START, CURVE_LEAST, CURVE_PLATEAU, CURVE_FALL, CURVE_DECAY, CURVE_NOISE, CURVE_FLOOR = 0.35, 0.06, 0.20, 0.0005, 0.4, 0.008, 0.95

# Seed, share of sure characters in percent, and thousandths of sure and other characters of the simulated engines.
TROCR_DRAWS = (42, 85, (800, 1000), (400, 700))
KRAKEN_DRAWS = (43, 80, (750, 1000), (350, 700))

# Words of the simulated engines' texts, and pixels a word.
SIMULATED_WORDS = ("romanz", "Engleterre", "Brut", "gent", "tindrent", "Normant", "vindrent", "comence")
PIXELS_PER_WORD = 60

# Document types of the contract, its bounds of the century, and the default licence.
DOCUMENT_TYPES = ("texte_simple", "deux_colonnes", "registre_tabulaire")
CENTURIES = (8, 17)
DEFAULT_LICENSE = "CC-BY-SA-4.0"

# Drawing colours of lines (blue, green, red), repeated from the start.
PALETTE = (
    (180, 119, 31), (14, 127, 255), (44, 160, 44), (40, 39, 214), (189, 103, 148),
    (75, 86, 140), (194, 119, 227), (127, 127, 127), (34, 189, 188), (207, 190, 23),
)
