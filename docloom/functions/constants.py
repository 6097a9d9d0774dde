"""Fixed values of the engine: patterns, word lists and maps whose contents decide results."""

from __future__ import annotations

# Entity patterns in the order in which labels are tried, and whether case is ignored.
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
ENTITY_PATTERNS: tuple[tuple[str, str, bool], ...] = (
    ("STATUTE", r"(?:Section|Sec\.?|S\.)\s+\d+[A-Z]?(?:\s*[\(\[][\divxIVX]+[\)\]])?(?:\s+(?:of|under|r/w)\s+(?:the\s+)?(?:Indian\s+Penal\s+Code|IPC|Cr\.?P\.?C\.?|CPC|Code\s+of\s+Criminal\s+Procedure|Code\s+of\s+Civil\s+Procedure|Evidence\s+Act|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+Act(?:\s*,?\s*\d{4})?))?", True),
    ("PROVISION", r"(?:Article|Art\.?)\s+\d+[A-Z]?(?:\s*[\(\[][\divx]+[\)\]])?(?:\s+of\s+the\s+Constitution(?:\s+of\s+India)?)?", True),
    ("ACT", r"(?:the\s+)?(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+)(?:Act|Ordinance|Code|Rules|Regulations)(?:\s*,?\s*\d{4})?", False),
    ("CASE_CITATION", r"(?:AIR\s+\d{4}\s+[A-Z]+(?:\s+\d+)?|\(\d{4}\)\s+\d+\s+SCC\s+\d+|\d{4}\s+(?:SCC|SCR|AIR)\s+[\(\d]+|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+v\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?:\s*[\(\[]\d{4}[\)\]])?|\[\d{4}\]\s+\d+\s+[A-Z]+\s+\d+)", False),
    ("COURT", r"(?:(?:Hon'?ble\s+)?Supreme\s+Court(?:\s+of\s+India)?|(?:Hon'?ble\s+)?High\s+Court(?:\s+of\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)?|(?:Hon'?ble\s+)?District\s+Court(?:\s+of\s+[A-Z][a-z]+)?|(?:Hon'?ble\s+)?Sessions\s+Court|(?:Hon'?ble\s+)?Magistrate(?:'s)?\s+Court|National\s+(?:Company\s+Law\s+)?Tribunal|NCLAT|NCLT|NGT|SAT|CAT|ITAT|CESTAT|(?:Hon'?ble\s+)?(?:Civil|Criminal|Family|Labour)\s+Court)", True),
    ("JUDGE", r"(?:(?:(?:Hon'?ble|Honourable)\s+)?(?:Chief\s+)?Justice\s+(?:(?:Dr\.?\s+)?[A-Z]\.?\s*)+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*|(?:J\.?\s*,?\s*(?:and\s+)?)+[A-Z][a-z]+)", False),
    ("LEGAL_ACTION", r"\b(?:bail|anticipatory\s+bail|regular\s+bail|appeal|cross[\s-]?appeal|special\s+leave\s+petition|writ\s+petition|habeas\s+corpus|FIR|first\s+information\s+report|chargesheet|charge\s*sheet|conviction|acquittal|sentence|sentencing|remand|parole|probation|injunction|stay\s+order|interim\s+order|review\s+petition|curative\s+petition|arbitration|mediation|conciliation|summons|warrant|notice|plea\s+bargain(?:ing)?|cognizable\s+offence|non[\s-]?cognizable|bailable|non[\s-]?bailable)\b", True),
    ("DATE", rf"(?:\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_MONTHS})\s*,?\s*\d{{4}}|\d{{1,2}}[/\-.]\d{{1,2}}[/\-.]\d{{2,4}}|(?:{_MONTHS})\s+\d{{1,2}}\s*,?\s*\d{{4}})", True),
    ("PARTY", r"\b(?:(?:the\s+)?(?:appellant|respondent|petitioner|defendant|plaintiff|complainant|accused|prosecution|applicant|opposite\s+party|intervener|claimant|counter[\s-]?claimant)s?)\b", True),
    ("PENALTY", r"\b(?:(?:rigorous|simple)?\s*imprisonment(?:\s+(?:for\s+)?(?:life|\d+\s+(?:years?|months?|days?)))?|(?:fine|penalty)\s+of\s+(?:Rs\.?\s*)?\d[\d,]*|death\s+(?:sentence|penalty)|compensation\s+of\s+(?:Rs\.?\s*)?\d[\d,]*|damages)\b", True),
)
#: First characters of whatever a pattern's letters can begin with, and whether digits can begin it too: most places
#: of a text are ruled out by them, before a pattern's alternatives are tried one by one.
ENTITY_STARTS: dict[str, tuple[str, bool]] = {
    "COURT": ("hon sup hig dis ses mag nat ncl ngt sat cat ita ces civ cri fam lab", False),
    "JUDGE": ("H C J", False),
    "LEGAL_ACTION": ("bai ant reg app cro spe wri hab fir cha con acq sen rem par pro inj sta int rev cur arb med sum war not ple cog non", False),
    "DATE": ("jan feb mar apr may jun jul aug sep oct nov dec", True),
    "PARTY": ("the app res pet def pla com acc pro opp int cla cou", False),
}
#: Acronyms and prefixes that match inside words; strict extraction puts word boundaries around these labels.
UNBOUNDED_LABELS = ("STATUTE", "PROVISION", "COURT")

# Section headings at line starts; group 1 is the type, group 2 the rest.
SECTION_PATTERNS: tuple[str, ...] = (
    r"^(SECTION|Section|Sec\.?)\s+(\d+[\.:]?\s*.*)",
    r"^(ARTICLE|Article)\s+([IVXLCDM\d]+[\.:]?\s*.*)",
    r"^(CLAUSE|Clause)\s+([\d\.]+[\.:]?\s*.*)",
    r"^(CHAPTER|Chapter)\s+([IVXLCDM\d]+[\.:]?\s*.*)",
    r"^(PART|Part)\s+([IVXLCDM\d]+[\.:]?\s*.*)",
    r"^(\d+(?:\.\d+)*)\.\s+([A-Z].*)",
)
HEADING_WORDS = "section|clause|article|paragraph|schedule|annexure|exhibit"

# Lexical tokens.
TOKEN = r"[a-z0-9][a-z0-9\.\-/]*"

# Stop words of question terms, of claim mapping and of claim checking.
QUERY_STOP_WORDS = tuple("a an and are be by can does for how if in is it of on or the to what when which who why".split())
CLAIM_STOP_WORDS = tuple("the a an is are was were in of to for and or not with that this on at by from as be it".split())
CHECK_STOP_WORDS = tuple("the a an is are was were in of to for and or not with that this".split())

# Question intents in order; the section intent also holds if the question has a STATUTE entity.
INTENT_MARKERS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("definition", ("what is", "define", "meaning of", "definition")),
    ("section", ("section",)),
    ("reasoning", ("why", "reason")),
    ("condition", ("can", "when", "if")),
    ("procedure", ("how to", "procedure", "process", "steps")),
    ("comparison", ("compare", "difference", "versus", "vs")),
    ("case_based", ("case", "judgment", "ruling", "verdict", "held")),
    ("factual", ("who", "which court", "which judge")),
)
# Markers that raise a chunk's or a sentence's score under an intent.
CHUNK_MARKERS = {"section": (("section",), 0.08), "definition": (("means", "refers to", "includes"), 0.06), "condition": (("provided that", "subject to", "shall"), 0.06)}
SENTENCE_MARKERS = {
    "definition": ("means", "refers to", "defined as"),
    "section": ("section",),
    "condition": ("if", "provided that", "subject to", "shall"),
    "reasoning": ("because", "therefore", "since", "held"),
}

# Labels of a general entity model and what they become (none: dropped).
MODEL_LABELS: dict[str, str | None] = {"ORG": "ORG", "PERSON": "PERSON", "DATE": "DATE", "LAW": "STATUTE", "GPE": "LOCATION", "MONEY": "MONEY", "CARDINAL": None, "ORDINAL": None, "NORP": None, "FAC": None, "PRODUCT": None}
COURT_WORDS = ("court", "tribunal", "bench", "commission")
JUDGE_STARTS = ("justice ", "judge ", "hon'ble justice ", "honourable justice ", "honorable justice ")
JUDGE_TITLES = ("justice", "judge", "cj", "c.j.")

# Colours (background, text, border) and descriptions of labels.
LEGEND: tuple[tuple[str, str, str, str, str], ...] = (
    ("STATUTE", "#dbeafe", "#1e40af", "#93c5fd", "Legal statute or section reference"),
    ("PROVISION", "#ede9fe", "#5b21b6", "#c4b5fd", "Constitutional article or provision"),
    ("COURT", "#fce7f3", "#9d174d", "#f9a8d4", "Court or tribunal name"),
    ("JUDGE", "#fef3c7", "#92400e", "#fcd34d", "Judge or justice name"),
    ("CASE_CITATION", "#d1fae5", "#065f46", "#6ee7b7", "Case citation reference"),
    ("LEGAL_ACTION", "#ffedd5", "#9a3412", "#fdba74", "Legal action or proceeding type"),
    ("DATE", "#e0e7ff", "#3730a3", "#a5b4fc", "Date reference"),
    ("PARTY", "#f3e8ff", "#7c3aed", "#c084fc", "Party to the case"),
    ("ACT", "#cffafe", "#155e75", "#67e8f9", "Name of a legal act or code"),
    ("PENALTY", "#fee2e2", "#991b1b", "#fca5a5", "Penalty, fine, or sentence"),
    ("JURISDICTION", "#ecfccb", "#3f6212", "#bef264", "Jurisdiction or geographical area"),
    ("ORG", "#f1f5f9", "#475569", "#94a3b8", "Organization"),
)

# Outcomes of answer generation.
NO_CONTEXT = "I could not find enough support in the indexed documents to answer this question."
WEAK_SUPPORT = "The top retrieved passage may be relevant, but I do not have enough sentence-level support to answer confidently."
