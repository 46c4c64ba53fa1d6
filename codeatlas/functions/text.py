"""Column functions on texts: cutting, cleaning, questions and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks, separators and limits of the output format.
TRUNCATED = "\n... [truncated]"
SEPARATOR = "\n\n---\n\n"
NO_CONTEXT = "(No relevant context found)"
MAX_SOURCE, MAX_CHUNK, MAX_CONTEXT = 500_000, 1500, 12_000

# What marks a question about structure.
STRUCTURAL = [
    r"\b(depend|depends|dependency|dependencies)\b",
    r"\b(inherit|extends|subclass|superclass|parent class)\b",
    r"\b(implements|interface)\b",
    r"\b(calls?|invokes?|call chain|call graph)\b",
    r"\b(imports?|imported by)\b",
    r"\bwhat classes\b",
    r"\bwho uses\b",
    r"\bimpact of changing\b",
    r"\bconnected to\b",
    r"\brelationship between\b",
]
MENTION = r"(?U)\b([A-Z][a-zA-Z0-9]{2,})\b"
# Control tokens that models leak.
LEAKED = ["<|im_start|>", "<|im_end|>", "<|EOT|>", "<|endoftext|>"]
# Labels before an answer, echoes of the instruction, and lines that are headings without a mark.
ANSWER_LABEL = r"(?i)\A(?:Response|Answer|Output)\s*:\s*\n?"
ECHO = r"(?is)###\s*(?:Instruction|System Prompt)\s*:.*?###\s*Response\s*:\s*"
HEADINGS = [
    "app name", "purpose", "target users", "core features", "architecture pattern", "layers", "presentation layer", "business logic layer", "data layer",
    "data flow", "authentication", "main features", "data storage", "communication", "ui elements", "navigation targets", "language", "android components",
    "libraries", "ui framework", "networking", "database", "di framework", "overview", "data sources", "state management", "key data flows", "api endpoints",
    "network clients", "data models",
]


def squeeze(text: Column) -> Column:
    """White space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def truncate(text: Column, limit: int = MAX_CHUNK) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(TRUNCATED))).otherwise(text)


def read_text(content: Column, max_chars: int = MAX_SOURCE) -> Column:
    """Bytes as UTF-8 with U+FFFD for bad ones, newlines as \\n, cut after ``max_chars``."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.substring(F.regexp_replace(text, r"\r\n?", "\n"), 1, max_chars)


def quoted_terms(question: Column) -> Column:
    """All contents of single or double quotes, joined by a blank."""
    pattern = F.lit(r"'([^']+)'|\"([^\"]+)\"")
    single, double = F.regexp_extract_all(question, pattern, F.lit(1)), F.regexp_extract_all(question, pattern, F.lit(2))
    return F.array_join(F.zip_with(single, double, lambda a, b: F.concat(a, b)), " ")


def is_structural(question: Column) -> Column:
    return question.rlike("(?i)" + "|".join(STRUCTURAL))


def class_mentions(question: Column, limit: int | None = None) -> Column:
    """Words in Pascal case in order, repeats kept."""
    found = F.regexp_extract_all(question, F.lit(MENTION), F.lit(1))
    return F.slice(found, 1, limit) if limit else found


def block_header(chunk_type: Column, name: Column, component: Column, layer: Column) -> Column:
    known = lambda c: F.coalesce(c, F.lit("?"))
    return F.concat(F.lit("["), known(chunk_type), F.lit("] "), known(name), F.lit(" ("), known(component), F.lit(", Layer: "), known(layer), F.lit(")"))


def format_block(chunk_type: Column, name: Column, component: Column, layer: Column, document: Column) -> Column:
    return F.concat(F.lit("### "), block_header(chunk_type, name, component, layer), F.lit("\n"), document)


def clean_response(text: Column) -> Column:
    """A model's answer without its thoughts and leaked tokens."""
    out = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"(?s)<think>.*\z", "")
    for token in LEAKED:
        out = F.replace(out, F.lit(token), F.lit(""))
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def extract_json(text: Column) -> Column:
    """The JSON object in an answer as text, with one repair after the other; null if none parses."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    body = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    commas = F.regexp_replace(body, r",\s*([}\]])", "$1")
    comments = F.regexp_replace(commas, r"(?m)(?<!:)//[^\n]*$", "")
    valid = lambda x: F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))).isNotNull()  # noqa: E731  in a list, nothing may follow the object
    tried = [F.when(valid(x), x) for x in (body, commas, comments)]
    return F.when(body != "", F.coalesce(*tried))


def humanize(name: Column) -> Column:
    """A screen's class name as words, without one suffix."""
    base = F.regexp_replace(name, r"(?<=.)(?:Activity|Fragment|Screen|Page)$", "")
    return squeeze(F.replace(F.regexp_replace(base, r"(?<=[a-z0-9])(?=[A-Z])", " "), F.lit("_"), F.lit(" ")))


def is_title_case(text: Column) -> Column:
    """Whether every run of letters starts with one capital and goes on in lower case, and there is one."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"(?:^|\P{L})\p{Ll}|\p{L}\p{Lu}")


def normalize_doc(text: Column) -> Column:
    """A generated document section with headings of level three and single blank lines."""
    body = F.regexp_replace(F.regexp_replace(strip(text), ANSWER_LABEL, ""), ECHO, "")

    def line(x):
        bare = strip(x)
        heading = strip(F.regexp_replace(bare, r"^#+", ""))
        shallow = bare.rlike(r"^#{1,3}(?!#)") & (heading != "")
        short = ~bare.startswith("#") & (F.length(bare) < 40) & (bare != "") & ~bare.rlike(r"[.:!?]$")
        known = F.lower(bare).isin(HEADINGS) | (is_title_case(bare) & bare.contains(" ") & (F.size(F.split(bare, r"(?U)\s+")) <= 4))
        return F.when(shallow, F.concat(F.lit("### "), heading)).when(short & known, F.concat(F.lit("### "), bare)).otherwise(x)

    lines = F.array_join(F.transform(F.split(body, "\n"), line), "\n")
    return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def strip_duplicate_title(content: Column, title: Column) -> Column:
    """``content`` without its first line if that is a heading which holds the title or is held by it."""
    plain = lambda c: F.lower(strip(F.regexp_replace(c, r"(?U)^[^\w]*", "")))
    first = F.regexp_extract(content, r"(?U)\A\s*(\S[^\n]*)", 1)
    heading = plain(strip(F.regexp_replace(strip(first), r"^#+", "")))
    wanted = plain(title)
    same = strip(first).startswith("#") & (heading != "") & (wanted != "") & (wanted.contains(heading) | heading.contains(wanted))
    return F.when(same, strip(F.regexp_replace(content, r"(?U)\A\s*\S[^\n]*", ""))).otherwise(content)
