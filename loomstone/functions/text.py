"""Column functions over text: measures, normal forms, scripts, markers, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDISH = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: Fixed: characters a token, tokens a word or mark.
CHARS_A_TOKEN, TOKENS_A_WORD = 3.6, 1.15
#: Fixed: languages told by script, in this order, with the script's code points.
SCRIPT_LANGUAGES = [("hi", r"ऀ-ॿ"), ("ru", r"Ѐ-ӿ"), ("el", r"Ͱ-Ͽ"), ("he", r"֐-׿"), ("ar", r"؀-ۿ"), ("ja", r"぀-ヿ"), ("zh", r"一-鿿"), ("ko", r"가-힯")]
#: Fixed: marker words of languages in Latin script, in order of precedence.
MARKERS = {
    "en": "the and of to in that is for with are as be this",
    "de": "der die das und ist nicht mit von für sich auch werden",
    "fr": "le la les des et est pour dans que une avec sur",
    "es": "el la los las de que es para con una por no",
    "it": "il lo la di che è per con una del non",
    "pt": "o a os as de que é para com uma do não",
    "nl": "de het een en van is niet met voor ook worden",
}
#: Fixed: words left out of keywords.
STOP_WORDS = (
    "a an and are as at be been but by for from has have if in into is it its of on or that the their there these this to was were will with "
    "which who whom whose you your we our not no can may shall should must also than then when where while"
).split()
#: Fixed: invisible characters (soft hyphen, zero-width, bidirectional, joiners, tags) and control characters.
INVISIBLE = r"[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{E0000}-\x{E007F}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
#: Fixed: media types by extension.
MEDIA_TYPES = {"md": "text/markdown", "txt": "text/plain", "html": "text/html", "csv": "text/csv", "json": "application/json", "pdf": "application/pdf"}


def text_of(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def estimate_tokens(c: str | Column) -> Column:
    """floor(max(characters / 3.6, words and marks * 1.15)), at least 1; none for an empty text."""
    t = text_of(c)
    guess = F.floor(F.greatest(F.length(t) / CHARS_A_TOKEN, F.regexp_count(t, F.lit(WORDISH)) * TOKENS_A_WORD))
    return F.when(t == "", 0).otherwise(F.greatest(guess, F.lit(1))).cast("long")


def normal(c: str | Column) -> Column:
    """Lower case, runs of anything but letters, digits and underscore as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), r"[^\p{L}\p{N}_]+", " "))


def exact_hash(c: str | Column) -> Column:
    return F.sha2(normal(c), 256)


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, where plain nesting would repeat it for every element of a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(c: str | Column, width: int = 4) -> Column:
    """Runs of ``width`` words of the normal form; the words themselves where there are no more."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda k: F.array_join(F.slice(w, k, width), " "))
    return let(words(normal(c)), lambda w: F.when(F.size(w) <= width, w).otherwise(runs(w)))


def hamming(a: str | Column, b: str | Column) -> Column:
    return F.bit_count((F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b))


def hex16(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def document_id(tenant: Column, uri: Column) -> Column:
    return F.substring(F.sha2(F.concat(tenant, F.lit("\0"), uri), 256), 1, 32)


def media_type(name: Column, default: str = "application/octet-stream") -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    return F.coalesce(kinds[F.lower(F.substring_index(name, ".", -1))], F.lit(default))


def block_normal(c: str | Column) -> Column:
    """Lines with white space collapsed, blank lines dropped, no-break spaces as spaces."""
    lines = F.transform(F.split(F.regexp_replace(text_of(c), " ", " "), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def paragraphs(c: str | Column) -> Column:
    return F.filter(F.transform(F.split(text_of(c), r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")


def strip_tags(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text_of(c), "<[^>]+>", " "), r"\s+", " "))


def query_normal(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(text_of(c))), r"\s+", " "), r"[?!. ]+$", "")


def is_abstract(c: str | Column) -> Column:
    """A short question, or one without digits, acronyms, quotes and dotted names."""
    t = F.trim(text_of(c))
    exact = t.rlike(r"[0-9]") | t.rlike(r"(^|[^\p{L}\p{N}_])[A-Z]{2,}($|[^\p{L}\p{N}_])") | t.rlike("[\"'`]") | t.rlike(r"[A-Za-z]\.[A-Za-z]")
    return (F.size(F.split(t, r"\s+")) <= 12) | ~exact


def invisible_count(c: str | Column) -> Column:
    return (F.regexp_count(text_of(c), F.lit(INVISIBLE)) + F.regexp_count(text_of(c), F.lit(CONTROL))).cast("long")


def latin_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))


def marker_votes(w: Column) -> dict[str, Column]:
    """How many of the words are markers of each language."""
    among = lambda own: lambda x: x.isin(*own)
    return {lang: F.size(F.filter(w, among(own.split()))) for lang, own in MARKERS.items()}


def language(c: str | Column, first: int = 4000, least: int = 8, default: str = "en") -> Column:
    """The first language whose script has max(least, n / 50) characters, else the first with the most marker words."""
    t = F.substring(text_of(c), 1, first)
    need = F.greatest(F.lit(least), F.floor(F.length(t) / 50))
    # The words, and then their votes, are computed once.
    names = F.array(*map(F.lit, MARKERS))
    best = lambda v: F.when(F.array_max(v) == 0, default).otherwise(F.element_at(names, F.array_position(v, F.array_max(v)).cast("int")))
    out = let(latin_words(t), lambda w: let(F.array(*marker_votes(w).values()), best))
    found = None
    for lang, span in SCRIPT_LANGUAGES:
        hit = F.regexp_count(t, F.lit(f"[{span}]")) >= need
        found = F.when(hit, lang) if found is None else found.when(hit, lang)
    foreign = t.rlike("[" + "".join(span for _, span in SCRIPT_LANGUAGES) + "]")
    return F.when(F.trim(t) == "", default).when(~foreign, out).otherwise(found.otherwise(out))


def _letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def iban_ok(c: str | Column) -> Column:
    """15 to 34 letters and digits without spaces whose number, the first four last and letters as 10 to 35, leaves 1 of 97."""
    v = F.upper(F.regexp_replace(text_of(c), r"\s", ""))
    moved = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))
    step = lambda s, x: F.when(x.rlike("[0-9]"), s * 10 + x.cast("int")).otherwise(s * 100 + F.ascii(x) - 55) % 97
    return F.when(~v.rlike("^[A-Z0-9]{15,34}$"), False).otherwise(F.aggregate(_letters(moved), F.lit(0).cast("long"), step) == 1)


def verhoeff_ok(c: str | Column) -> Column:
    """Whether the digits of a text check out in the dihedral group of ten: place k applies the k-th power of a permutation."""
    turn = F.array(*map(F.lit, (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)))
    digits = F.reverse(_letters(F.regexp_replace(text_of(c), "[^0-9]", "")))
    turned = F.transform(digits, lambda x, k: F.aggregate(F.when(k % 8 > 0, F.sequence(F.lit(1), k % 8)).otherwise(F.array().cast("array<int>")), x.cast("int"), lambda d, _: F.element_at(turn, d + 1)))
    # Elements under 5 turn, the others turn and flip; a flip reverses what comes after it.
    step = lambda a, b: F.when((a < 5) & (b < 5), (a + b) % 5).when(a < 5, (a + b - 5) % 5 + 5).when(b < 5, (a - 5 - b + 5) % 5 + 5).otherwise((a - b + 5) % 5)
    return F.aggregate(turned, F.lit(0), step) == 0


def pipe_table(rows: Column) -> Column:
    """A pipe table of an array of rows, the first its head; blank rows go, short rows are filled up."""
    cell = lambda x: F.replace(F.replace(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    full = F.filter(rows, lambda r: F.exists(r, lambda x: F.trim(x) != ""))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def drawn(own: Column) -> Column:
        wide = F.array_max(F.transform(own, lambda r: F.size(r)))
        fill = lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), wide - F.size(r)))
        lines = F.transform(own, lambda r: line(fill(r)))
        return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(line(F.array_repeat(F.lit("---"), wide))), F.slice(lines, 2, 1 << 30)), "\n")

    return F.when(F.size(full) == 0, "").otherwise(let(full, drawn))
