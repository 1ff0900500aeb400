"""Text functions: Column in, Column out, no Python in the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import stable

# --- fixed values: word lists, patterns and names that results depend on --------------------------------------
FILLER_WORDS = [
    "the", "a", "an", "and", "or", "for", "of", "in", "on", "to", "with", "is", "are", "was", "be", "by", "at", "as", "from", "this", "that",
    "it", "its", "we", "i", "need", "want", "looking", "find", "please", "standard", "standards", "specification", "tender", "procurement",
    "product", "item", "material", "quality", "requirement", "requirements",
]
QUERY_NOISE = [
    "of", "in", "to", "by", "at", "as", "is", "be", "on", "or", "an", "it", "we", "us", "no", "do", "if", "so", "up", "my", "the", "and", "for",
    "with", "from", "that", "this", "shall", "any", "per", "our", "your", "are", "was", "were", "has", "have", "had", "standard", "standards",
    "specification", "specifications", "tender", "procurement", "purchase", "supply", "quality", "requirement", "requirements", "product",
    "item", "material", "type", "used", "use", "make", "made", "grade", "part", "section", "indian",
]
SEARCH_NOISE = ["mnt", "mounted", "type", "supply", "make", "model", "qty", "quantity", "nos", "with", "and", "for", "the", "of", "as", "per", "conforming", "required", "item", "approx"]
TITLE_NOISE = [
    "the", "and", "for", "of", "in", "on", "to", "with", "part", "section", "specification", "specifications", "indian", "standard",
    "standards", "requirements", "requirement", "method", "methods", "general", "determination", "code", "practice", "guidelines", "revision",
]
ACRONYMS = [
    "PVC", "UPVC", "HDPE", "LDPE", "LLDPE", "GI", "MS", "RCC", "PCC", "AC", "DC", "HT", "LT", "LPG", "CNG", "PNG", "UV", "IR", "LED", "ISO",
    "IEC", "BIS", "ASTM", "CRS", "QCO", "MDF", "HDF", "GRP", "FRP", "PPE", "EV", "AAC", "ACSR", "XLPE", "PET", "PP", "PE", "PU",
]
WATERMARKS = [
    r"Free Standard provided by BIS[\s\S]{0,300}?\d{1,3}(?:\.\d{1,3}){3}\.?",
    r"Licen[cs]ed?\s+to[\s\S]{0,200}?\d{1,3}(?:\.\d{1,3}){3}\.?",
    r"Downloaded\s+by[\s\S]{0,200}?\d{1,3}(?:\.\d{1,3}){3}\.?",
]
PERSONAL = r"[\w.+-]+@[\w-]+\.[\w.]{2,}|(?:\+?91[\s-]?)?\b[6-9]\d{9}\b"
PRIVATE_COLUMN = r"(?i)e[\s_-]?mail|mobile|phone|contact|address"
LEGACY_FONTS = (
    r"(?i)kruti|chanakya|dev[\s_-]?lys|shusha|shivaji|(?<![a-z])agra|shree[\s_-]?(?:dev|lipi)|amarujala|jagran|naidunia|yogesh|kundli|"
    r"aps[\s_-]?dv|bhasha|millennium|x[\s_-]?dvng|isfoc|gist[\s_-]?dv|sanskrit[\s_-]?99|preeti|kantipur|akruti"
)
#: Ordered: the first that matches a title names its role.
TITLE_ROLES = [
    ("test method", r"method[s]?\s+(?:of|for)\s+test|test\s+method|method\s+for\s+determination|determination\s+of|methods?\s+of\s+(?:chemical|physical)"),
    ("sampling", r"\bsampling\b"),
    ("terminology", r"\bglossary\b|\bterminology\b|\bdefinitions\b|\bnomenclature\b"),
    ("code of practice", r"code\s+of\s+practice|\bguidelines?\b|recommendations?\s+for|care\s+and\s+maintenance|installation|handling|storage"),
    ("product specification", r"specification|\bspec\b"),
]
REFERENCE_ROLES = [
    ("general convention", r"rounding\s+off|significant\s+places"),
    ("test method", r"method[s]?\s+of\s+test|methods?\s+of\s+sampling|test\s+method|determination|assay|analysis"),
    ("sampling", r"sampling"),
    ("terminology", r"glossary|terminolog|definitions|terms\s+relating"),
    ("safety", r"safety|hazard|protective\s+equipment"),
    ("installation", r"code\s+of\s+practice|installation|erection|laying"),
    ("product specification", r"specification|shall\s+conform|conforming\s+to"),
]
PLACEHOLDER = r"\[([A-Z][A-Z /'’\-]+)\]"
SAFE_TITLE_CHARS = r"A-Za-z0-9 .,()/&:;'\-–—―‘’“”°′″"
LEGACY_GLYPHS = "¼½¾ØðþýÞ¡¿ªº§¶†‡"
TITLE_BOILERPLATE = ["indianstandard", "indianstandards", "bureauofindianstandards", "hindi", "draft", "foreword", "contents", "scope"]
SILENCE_PHRASES = [
    "thank you", "thank you very much", "thanks", "thanks for watching", "thank you for watching", "thank you so much for watching",
    "please subscribe", "like and subscribe", "you", "bye", "bye bye", "okay", "ok", "so", "uh", "um", "hmm", "music",
    "subtitles by the amara org community",
]
# ----------------------------------------------------------------------------------------------------------------


def _without(words: Column, noise: Sequence[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*noise))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _kept(text: Column, pattern: str) -> Column:
    """How many characters stay when the runs of others go; no list of matches is made. Patterns name what goes: Java tries a negated
    class of ranges, such as [^A-Za-z], many times slower than a plain one or a property."""
    return F.length(F.regexp_replace(text, pattern, ""))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, of any script."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " ")
    return F.array_remove(F.split(spaced, " "), "")


def short_tokens(text: Column) -> Column:
    """Runs of two or more of a-z and 0-9, lower-cased."""
    return _all(F.lower(F.coalesce(text, F.lit(""))), "[a-z0-9]{2,}")


def query_terms(text: Column) -> Column:
    return _without(short_tokens(text), QUERY_NOISE)


def meaningful_terms(text: Column) -> Column:
    return _without(F.filter(_all(F.lower(F.coalesce(text, F.lit(""))), "[a-zA-Z0-9]+"), lambda w: F.length(w) > 2), FILLER_WORDS)


def title_words(text: Column) -> Column:
    """Distinct words of a title that can tell it apart."""
    return F.array_distinct(_without(F.filter(_all(F.lower(F.coalesce(text, F.lit(""))), "[a-z0-9]+"), lambda w: F.length(w) > 2), TITLE_NOISE))


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends; null: empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def strip_watermarks(text: Column, patterns: Sequence[str] = WATERMARKS) -> Column:
    """struct(text, removed): marks that end in an IPv4 address go, blank space is tidied; removed counts all of it."""
    t = F.coalesce(text, F.lit(""))
    out = t
    for p in patterns:
        out = F.regexp_replace(out, "(?i)" + p, " ")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n\s*\n\s*\n+", "\n\n")
    out = F.regexp_replace(out, r"^\s+|\s+$", "")
    return F.struct(out.alias("text"), (F.length(t) - F.length(out)).alias("removed"))


def redact(text: Column) -> Column:
    return F.regexp_replace(text, PERSONAL, "[redacted]")


def normalise_html(html: Column) -> Column:
    """Scripts, styles, volatile attributes and token texts go; white space is squeezed."""
    return stable(html)


def json_object(text: Column) -> Column:
    """The text from the first { to the last }, fences dropped; null where there is none."""
    t = F.regexp_replace(F.trim(text), r"(?m)^```(?:json)?|```$", "")
    return F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit(""))


def first_role(text: Column, rules: Sequence[tuple[str, str]], otherwise: Column) -> Column:
    out = otherwise
    low = F.lower(F.coalesce(text, F.lit("")))
    for name, pattern in reversed(rules):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def role_of(title: Column) -> Column:
    return first_role(title, TITLE_ROLES, F.lit("product specification"))


def infer_role(title: Column, context: Column) -> Column:
    return first_role(title, REFERENCE_ROLES, first_role(context, REFERENCE_ROLES, F.lit("normative reference")))


def match_score(logit: Column) -> Column:
    """1..99 by the logistic curve, rounded half to even; null for null or NaN."""
    raw = F.rint(F.lit(100.0) / (F.lit(1.0) + F.exp(-logit)))
    return F.when(logit.isNotNull() & ~F.isnan(logit), F.greatest(F.lit(1), F.least(F.lit(99), raw.cast("int"))))


def normalise_id(text: Column, upper: bool = True) -> Column:
    out = squeeze(text)
    return F.upper(out) if upper else F.lower(out)


def snippet(text: Column, size: int = 200) -> Column:
    t = squeeze(text)
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, size)), F.lit("...")))


def has_devanagari(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("[\\u0900-\\u097F]")


def legacy_font(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(LEGACY_FONTS)


def page_method(text: Column, ocr: Column, fonts_legacy: Column, hindi: bool = False, least: int = 200) -> Column:
    """struct(text, method, legacy_font): the page's own text where it is long enough, else the longer of it and the
    OCR; a legacy-font page takes OCR that has Devanagari."""
    t, o = F.coalesce(text, F.lit("")), F.coalesce(ocr, F.lit(""))
    by_ocr = (F.length(t) < least) & (F.length(o) > F.length(t))
    now, method = F.when(by_ocr, o).otherwise(t), F.when(by_ocr, F.lit("ocr")).otherwise(F.lit("text"))
    suspect = F.coalesce(fonts_legacy, F.lit(False)) & ~has_devanagari(now)
    better = suspect & has_devanagari(o)
    now = F.when(better, o).otherwise(now)
    method = F.when(better, F.lit("ocr")).when(suspect, F.lit("legacy-font")).otherwise(method)
    flag = F.coalesce(fonts_legacy, F.lit(False)) & ~(better & F.lit(hindi))
    return F.struct(now.alias("text"), F.when(now == "", F.lit("empty")).otherwise(method).alias("method"), flag.alias("legacy_font"))


def roman_share(text: Column) -> Column:
    """ASCII letters and digits over the characters that are no punctuation or white space (newlines taken off twice)."""
    t = F.coalesce(text, F.lit(""))
    rest = _kept(t, r"[!-/:-@\[-`{-~\s]+") - (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))))
    return F.coalesce(F.try_divide(_kept(t, r"\P{Alnum}+"), rest), F.lit(0.0))


def language_gate(language: Column, confidence: Column, least: float = 0.6) -> Column:
    l = F.trim(F.coalesce(language, F.lit("")))  # noqa: E741
    return F.when((l == "") | (l == "other") | (F.coalesce(confidence, F.lit(0.0)) < least), F.lit("en")).otherwise(l)


def sentence_case(text: Column, acronyms: Sequence[str] = ACRONYMS) -> Column:
    """Words lower-cased but for the first, which gets a capital, acronyms and single letters. The capital of ß is one letter too."""
    upper = lambda x: F.upper(F.translate(x, "ß", "ẞ"))

    def one(w: Column, i: Column) -> Column:
        bare = upper(F.regexp_replace(w, r"""^['"()\[\],.]+|['"()\[\],.]+$""", ""))
        letter = (F.length(F.regexp_replace(w, r"\P{L}", "")) == 1) & (F.length(w) <= 3)
        capital = F.concat(upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
        return F.when(bare.isin(*acronyms) | letter, w).when(i == 0, capital).otherwise(F.lower(w))

    return F.array_join(F.transform(F.split(squeeze(text), " "), one), " ")


def title_phrase(text: Column) -> Column:
    t = squeeze(text)
    return F.when((F.upper(t) == t) & (F.lower(t) != t), F.initcap(t)).otherwise(t)


def placeholders(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PLACEHOLDER), F.lit(1))))


def fill_placeholders(text: Column, values: Column) -> Column:
    """values: map of bracketed blank to text; blanks without a value stay."""
    entries = F.map_entries(values)
    return F.aggregate(entries, text, lambda t, e: F.when(F.coalesce(e["value"], F.lit("")) != "", F.replace(t, e["key"], e["value"])).otherwise(t))


def answers_as_text(labels: Column) -> Column:
    cut = F.transform(labels, lambda x: F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"^Part\s+[0-9A-Za-z/ ]*-\s*", ""))
    return F.array_join(F.filter(cut, lambda x: x != ""), "; ")


def column_key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(squeeze(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def is_boilerplate(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]", "").isin(*TITLE_BOILERPLATE)


def latin_share(text: Column) -> Column:
    return F.when(text.isNotNull(), F.coalesce(F.try_divide(_kept(text, r"\P{Alpha}+"), _kept(text, r"\P{L}+")), F.lit(0.0)))


def digit_share(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(F.regexp_count(text, F.lit("[0-9]")) / F.length(text))


def garbled(text: Column) -> Column:
    """Signs of a legacy font: its glyphs, odd characters, or words without vowels. A word is known by its letters alone, so that all
    else but white space goes first; words are only counted where there is one without vowels, and no list of them is made."""
    t = F.coalesce(text, F.lit(""))
    odd = _kept(t, f"[{SAFE_TITLE_CHARS}]+")
    letters = F.regexp_replace(t, r"[^\p{L}\s]+", "")
    bare = r"(?:^|\s)[\p{L}&&[^aeiouAEIOU]]{4,}+(?=\s|\z)"
    n_words, n_bare = F.regexp_count(letters, F.lit(r"\p{L}++")), F.regexp_count(letters, F.lit(bare))
    return (t == "") | t.rlike(f"[{LEGACY_GLYPHS}]") | ((odd >= 2) & (odd > 0.02 * F.length(t))) | (letters.rlike(bare) & (n_words >= 2) & (n_bare > 0.4 * n_words))


def audio_rejection(text: Column, logprob: Column, no_speech: Column, most_silent: float = 0.6, least_logprob: float = -1.0, silence: Sequence[str] = SILENCE_PHRASES) -> Column:
    """Why a transcript is not to be searched; null where it may be."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit("no speech"))
        .when(plain.isin(*silence), F.lit("silence phrase"))
        .when(logprob.isNull() | no_speech.isNull(), F.lit("no scores"))
        .when(no_speech > most_silent, F.lit("no_speech_prob too high"))
        .when(logprob < least_logprob, F.lit("avg_logprob too low"))
    )


def citation(standard_id: Column, source: Column, page: Column, method: Column) -> Column:
    label = F.coalesce(F.nullif(standard_id, F.lit("")), F.nullif(source, F.lit("")), F.lit("Unknown"))
    return F.concat(label, F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(", page "), page.cast("string"))).otherwise(F.lit("")), F.when(F.coalesce(method, F.lit("")).startswith("ocr"), F.lit(" [OCR]")).otherwise(F.lit("")))
