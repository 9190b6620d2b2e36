"""Text expressions: normal forms, visibility, page kinds, flags and amounts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the titles that open a page, with the page kind. Fixed values; the first match counts.
PAGE_TITLES = {
    "^Manual Adjudicator Note": "adjudicator",
    "^FORM I-8090": "intake",
    "^FORM B-13": "biometric",
    "^Sponsor Attestation": "sponsor_letter",
    "^Planetary Registry Extract": "registry",
    "^[A-Z]{3} Fee Receipt": "fee_receipt",
}
#: Trust rank of each source; 0 is trusted most, 9 not at all. Fixed values.
TRUST = {"manual_correction": 0, "adjudicator": 1, "intake": 2, "fee_receipt": 2, "biometric": 3, "sponsor_letter": 4, "registry": 5, "scanned_page": 6, "scanned_page_fallback": 7, "unknown": 9}
POLICY_TRUST = 6
#: What a damage marker destroys. Fixed values.
DAMAGE = {
    "NAME CUT OUT": "applicant_name",
    "SPECIES WHITEOUT": "species_code",
    "DATE WASHED OUT": "arrival_date",
    "SPONSOR ID BLANK": "sponsor_id",
    "VISA CLASS TORN": "visa_class",
    "PURPOSE ILLEGIBLE": "declared_purpose",
    "FEE STATUS OBSCURED": "fee_status",
}
#: What a damage marker looks like, and words that stand where a destroyed value was. Fixed values.
MARKER = r"\[[A-Z0-9 _-]{3,40}\]"
SENTINELS = ("UNREADABLE", "ILLEGIBLE", "OBSCURED", "TORN", "WHITEOUT")
#: Phrases in hidden text that give an injection away. Fixed values.
INJECTION_CUES = ("ignore", "answer key", "system:", "approve", "must be", "output this")
#: What a machine-written line begins with. Fixed values.
MACHINE_WORDS = ("BARCODE", "QR", "MRZ")
#: Letters that scans show for digits. Fixed values.
DIGIT_LOOKS = {"0": "OoQD", "1": "Ili|", "2": "Zz", "4": "A", "5": "Ss", "6": "G", "7": "Tt", "8": "B", "9": "gq"}
#: What scans show for the letters of a sponsor id's prefix. Fixed values.
PREFIX_LOOKS = {"S": "S5", "P": "PR", "N": "N"}
#: What may part a sponsor id's prefix from its digits, and the parts of a date. Fixed values.
SPONSOR_GAPS = " \t\n\r\f\v.:;,-_"
DATE_GAPS = (" ", "\t", "\n", "\r", "\f", "\v", ".", "-", "/", "\u2013", "\u2014")
#: Page furniture that a scan line can carry: as it stands, and what takes the rest of the line with it. Fixed values.
FURNITURE = ("SCAN IMAGE", "REGISTRY IMAGE", "PASSPORT IMAGE", "CASEWORK", "[A-Z]{3} Eyes Only")
FURNITURE_TO_END = ("Synthetic hiring", r"Packet [A-Z]{3}-\d+")


def lookup(values: dict, key: Column, default: Column | None = None) -> Column:
    """Literal dictionary as a CASE; equality joins with tiny fixed tables need no join."""
    out = F.lit(None)
    for k, v in reversed(list(values.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out if default is None else F.coalesce(out, default)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def canon(c: Column) -> Column:
    """Lower case without anything but a-z and 0-9."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def clean(c: Column) -> Column:
    """White space collapsed and trimmed, Unicode white space included."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm(c: Column) -> Column:
    return F.lower(clean(c))


def luminance(rgb: Column) -> Column:
    """Relative luminance of a packed sRGB colour."""

    def channel(shift: int) -> Column:
        v = F.shiftright(rgb, shift).bitwiseAND(F.lit(255)) / 255.0
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    return 0.2126 * channel(16) + 0.7152 * channel(8) + 0.0722 * channel(0)


def disjoint(a: Column, b: Column) -> Column:
    """Whether two rectangles (x0, y0, x1, y1) share no area."""
    return (a["x1"] <= b["x0"]) | (a["x0"] >= b["x1"]) | (a["y1"] <= b["y0"]) | (a["y0"] >= b["y1"])


def hide_reasons(alpha: Column, color: Column, bbox: Column, visible: Column) -> Column:
    """Why a span cannot be seen, in order: invisible, white, offcrop."""
    return F.array_compact(F.array(F.when(alpha == 0, F.lit("invisible")), F.when(luminance(color) >= 0.93, F.lit("white")), F.when(disjoint(bbox, visible), F.lit("offcrop"))))


def rotated(page_rotation: Column, dir_y: Column) -> Column:
    return (F.pmod(page_rotation, F.lit(360)) != 0) | (F.abs(dir_y) > 0.01)


def non_evidentiary(c: Column) -> Column:
    """Lines that machines wrote for machines: their first word says so, and a colon follows."""
    first = F.upper(F.regexp_extract(c, r"^\s*(\w+)", 1))
    return first.isin(*MACHINE_WORDS) & F.contains(c, F.lit(":"))


def page_kind(title: Column) -> Column:
    out = F.lit("unknown")
    for start, kind in reversed(list(PAGE_TITLES.items())):
        out = F.when(title.rlike(start), kind).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def stamp(text: Column, size: Column) -> Column:
    """``struct(word, sample)`` of a stamp-sized span: an outcome word, or a SAMPLE mark."""
    big = size >= 18.0
    upper = F.upper(F.trim(text))
    sample = big & F.contains(upper, F.lit("SAMPLE"))
    word = F.when(big & ~sample & upper.isin("APPROVED", "DENIED", "REVIEW", "NEEDS_REVIEW"), upper)
    return F.struct(word.alias("word"), F.coalesce(sample, F.lit(False)).alias("sample"))


def damaged_fields(text: Column) -> Column:
    """Fields that bracketed markers in the text declare destroyed."""
    inside = F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+)\]"), 1), lambda m: F.trim(m))
    known = F.create_map(*[F.lit(x) for kv in DAMAGE.items() for x in kv])
    return F.array_compact(F.transform(inside, lambda m: F.try_element_at(known, m)))


def injected(hidden_text: Column, has_non_evidentiary: Column) -> Column:
    """Hidden text with a cue, or any text that carries no evidence."""
    low = F.lower(hidden_text)
    cue = F.lit(False)
    for c in INJECTION_CUES:
        cue = cue | F.contains(low, F.lit(c))
    return F.coalesce(cue, F.lit(False)) | F.coalesce(has_non_evidentiary, F.lit(False))


def flags(c: Column) -> Column:
    """Sorted distinct flags of a pipe-separated list; blanks and ``none`` do not count."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: ~x.isin("", "none"))))


def flag_string(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.array_join(F.array_sort(F.array_distinct(c)), "|")).otherwise(F.lit("none"))


def money(c: Column) -> Column:
    return F.regexp_replace(c, r"[$,\s]", "").try_cast("double")


def fee_of(amount: Column, waiver: Column) -> Column:
    """paid, waived or null: an amount without a waiver, or a waiver without an amount."""
    value, code = money(amount), F.upper(F.trim(waiver))
    none = code.isNull() | code.isin("N/A", "NA", "NONE", "N/4", "WA", "")
    return F.when((value > 0) & none, F.lit("paid")).when((value == 0) & ~none, F.lit("waived"))


def strip_debris(c: Column) -> Column:
    """Page furniture, a stray sign or letter at the end, and outer punctuation removed."""
    whole, to_end = "|".join(FURNITURE), "|".join(FURNITURE_TO_END)
    x = F.regexp_replace(F.regexp_replace(c, rf"(?i)\b(?:{to_end}).*", " "), rf"(?i)\b(?:{whole})\b", " ")
    x = F.rtrim(F.regexp_replace(x, r"\s+[^A-Za-z0-9]\s*$", ""))
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    x = F.when(F.size(words) > 2, F.regexp_replace(x, r"\s+[A-Za-z]$", "")).otherwise(x)
    return F.btrim(clean(x), F.lit(" |.,;:-_"))


def digits(c: Column) -> Column:
    """Look-alike letters as digits; null unless all are digits then."""
    x = F.translate(c, "".join(DIGIT_LOOKS.values()), "".join(d * len(v) for d, v in DIGIT_LOOKS.items()))
    return F.when(x.rlike("^[0-9]+$"), x)


def mine_sponsors(text: Column) -> Column:
    """Sponsor ids in a text, their prefix and digits misread or not, with up to three separators or none.

    The text is cut before each prefix, and a fold looks behind it: at most three separators, four
    letters, digits or bars, and no digit then. What one id took is not looked at again.
    """
    size = len(PREFIX_LOOKS)
    prefix = "".join(f"[{looks}]" for looks in PREFIX_LOOKS.values())

    def step(acc: Column, x: Column) -> Column:
        hit = (acc["taken"] <= 0) & x["id"].isNotNull()
        taken = F.when(hit, size + x["gap"] + 4).otherwise(acc["taken"]) - x["n"]
        return F.struct(F.when(hit, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"), taken.alias("taken"))

    def behind(x: Column) -> Column:
        after = lambda t: F.struct(t.alias("t"), F.ltrim(t, F.lit(SPONSOR_GAPS)).alias("bare"))
        ok = lambda y: (F.length(y["t"]) - F.length(y["bare"]) <= 3) & x["t"].rlike(f"^{prefix}") & y["bare"].rlike("^[0-9A-Za-z|]{4}([^0-9]|$)")
        found = lambda y: F.struct(x["n"].alias("n"), (F.length(y["t"]) - F.length(y["bare"])).alias("gap"), F.when(ok(y), F.substring(y["bare"], 1, 4)).alias("id"))
        return bind(after(F.substring(x["t"], size + 1, 8)), found)

    def found(pieces: Column) -> Column:
        # a piece and the few signs behind it, which may be the next piece's
        ahead = F.transform(pieces, lambda x, i: F.struct(F.length(x).alias("n"), F.substring(F.array_join(F.slice(pieces, i + 1, 6), ""), 1, size + 8).alias("t")))
        start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(0).alias("taken"))
        return F.aggregate(F.transform(ahead, behind), start, step, lambda acc: acc["ids"])

    ids = F.transform(bind(F.split(text, f"(?={prefix})"), found), digits)
    return F.transform(F.filter(ids, lambda x: x.isNotNull()), lambda x: F.concat(F.lit("SPN-"), x))


def mine_dates(text: Column) -> Column:
    """Dates in a text, repaired and range-checked; no calendar check.

    The text is cut into runs of letters, digits and bars, with what parts them. Three runs in a row
    are a date if one separator parts them and the last four, all two and the first two signs of
    them are digits or look like them; no digit stands before or behind.
    """
    among = "0-9A-Za-z|"
    full = lambda x: F.filter(x, lambda part: part != "")
    parts = F.struct(full(F.split(text, f"[^{among}]+")).alias("runs"), full(F.split(text, f"[{among}]+")).alias("gaps"), F.when(F.substring(text, 1, 1).rlike(f"[{among}]"), 0).otherwise(1).alias("lead"))
    one = F.array(*map(F.lit, DATE_GAPS))

    def whole(x: Column) -> Column:
        free = (~F.substring(x["a"], -5, 1).between("0", "9") | (F.length(x["a"]) == 4)) & ~F.substring(x["c"], 3, 1).between("0", "9")
        return (F.length(x["a"]) >= 4) & (F.length(x["b"]) == 2) & (F.length(x["c"]) >= 2) & free & F.array_contains(one, x["p"]) & F.array_contains(one, x["q"])

    def three(p: Column, k: Column) -> Column:
        run, gap = (lambda n: F.get(p["runs"], k + n)), (lambda n: F.get(p["gaps"], k + n + p["lead"]))
        return F.struct(run(0).alias("a"), run(1).alias("b"), run(2).alias("c"), gap(0).alias("p"), gap(1).alias("q"))

    def found(p: Column) -> Column:
        triples = F.transform(F.sequence(F.lit(0), F.greatest(F.size(p["runs"]) - 3, F.lit(0))), lambda k: three(p, k))
        dates = F.transform(F.filter(triples, whole), lambda x: F.struct(digits(F.right(x["a"], F.lit(4))).alias("y"), digits(x["b"]).alias("m"), digits(F.substring(x["c"], 1, 2)).alias("d")))
        good = F.filter(dates, lambda x: x["y"].between("2000", "2099") & x["m"].between("01", "12") & x["d"].between("01", "31"))
        return F.transform(good, lambda x: F.concat_ws("-", x["y"], x["m"], x["d"]))

    return bind(parts, found)


def mine_flags(text: Column) -> Column:
    """Tokens shaped like flags, as they stand: a word of three letters or more, an underscore, one of two or more."""
    return F.regexp_extract_all(text, F.lit(r"\b([A-Za-z]{3,}_[A-Za-z]{2,})\b"), 1)


def respace(c: Column, labels: list[str]) -> Column:
    """The label that ends a text, its blanks put back where a reader dropped them; the longest label wins.

    Texts without a label at their end are as they were, but for a blank between a small and a
    capital letter.
    """
    flat = F.regexp_replace(F.lower(c), "[^a-z]", "")
    out = F.regexp_replace(c, r"(?<=[a-z])(?=[A-Z])", " ")
    for label in sorted(labels, key=len):  # the last condition is asked first
        out = F.when(F.endswith(flat, F.lit(label.replace(" ", ""))), F.lit(label)).otherwise(out)
    return out


def label_score(text: Column, labels: list[str]) -> Column:
    """How many known labels a text contains."""
    low = F.lower(text)
    return F.size(F.filter(F.array(*map(F.lit, labels)), lambda x: F.contains(low, x)))


def near_mark(text: Column, pattern: str, mark: str = "SAMPLE", window: int = 60) -> Column:
    """Whether every match of ``pattern`` lies within ``window`` characters of the mark.

    Matches are told by their places: the text is cut at each of them, and what stands
    around a cut is looked at, so near matches see each other's surroundings.
    """

    def inside(p: Column) -> Column:
        ends = lambda i: F.length(F.array_join(F.slice(p["gaps"], 1, i + 1), "")) + F.length(F.array_join(F.slice(p["found"], 1, i + 1), ""))
        at = F.transform(p["found"], lambda m, i: F.struct(F.length(m).alias("n"), ends(i).alias("end")))
        around = F.transform(at, lambda m: F.substring(text, F.greatest(F.lit(1), m["end"] - m["n"] - window + 1), m["n"] + window + F.least(F.lit(window), m["end"] - m["n"])))
        return (F.size(p["found"]) > 0) & F.forall(around, lambda h: F.contains(F.upper(h), F.lit(mark)))

    return bind(F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1).alias("found"), F.split(text, pattern).alias("gaps")), inside)


def attestation(text: Column) -> Column:
    """``struct(sponsor, applicant, purpose, visa)`` of a sponsor's letter; null where it says nothing.

    The letter says: Sponsor <id> attests that <name> is expected on Earth for <purpose>.
    Elsewhere: class <visa> compliance.
    """
    t = clean(text)
    sponsor = F.regexp_extract(t, r"Sponsor (SPN-\d{4}) attests that ", 1)
    rest = F.substring(t, F.instr(t, F.concat(sponsor, F.lit(" attests that "))) + F.length(sponsor) + 14, F.length(t))
    halves = F.split(rest, " is expected on Earth for ", 2)
    said = (sponsor != "") & (F.size(halves) == 2) & F.contains(F.get(halves, F.lit(1)), F.lit("."))
    part = lambda c: F.when(said, F.nullif(F.trim(c), F.lit("")))
    visa = F.upper(F.regexp_extract(t, r"(?i)\bclass ([a-z]+-\d+) compliance", 1))
    return F.struct(part(sponsor).alias("sponsor"), part(F.get(halves, F.lit(0))).alias("applicant"), part(F.substring_index(F.get(halves, F.lit(1)), ".", 1)).alias("purpose"), F.nullif(visa, F.lit("")).alias("visa"))


def correction(text: Column, subjects: dict[str, str]) -> Column:
    """``struct(field, value)`` of a manual correction, "Manual correction: <subject> is <value>."; null if the text is none."""
    t = clean(text)
    opened = F.startswith(F.lower(t), F.lit("manual correction:"))
    halves = F.split(F.substring(t, F.lit(len("manual correction:") + 1), F.length(t)), r"(?i) is ", 2)
    field = lookup(subjects, norm(F.get(halves, F.lit(0))))
    value = F.rtrim(F.regexp_replace(F.trim(F.get(halves, F.lit(1))), r"\.$", ""))
    return F.when(opened & field.isNotNull() & (value != ""), F.struct(field.alias("field"), value.alias("value")))


def note_parts(text: Column) -> Column:
    """``struct(finding, reason)`` of a text that says "Finding: <word>. Reason: <rest>"; null if it does not."""
    said = r"(?is)Finding:\s*([a-z_]+)\.\s*Reason:\s*(.*)"
    return F.when(text.rlike(said), F.struct(F.regexp_extract(text, said, 1).alias("finding"), F.regexp_extract(text, said, 2).alias("reason")))
