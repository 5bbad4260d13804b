"""Machine-readable identity lines as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (type, score, pattern, least and greatest length, fillers needed), tried in this order.
LINE_TYPES = (
    ("TD3_L1", 100, r"^P<[A-Z]{3}[A-Z]+<<[A-Z<]+$", 42, 46, 5),
    ("TD3_L2", 100, r"^[A-Z0-9<]{9}[0-9][A-Z]{3}[0-9]{6}[0-9][MF<][0-9]{6}[0-9]", 42, 46, 3),
    ("TD1_L1", 90, r"^[IAC][A-Z<][A-Z]{3}[A-Z0-9<]{24}$", 28, 32, 3),
    ("TD1_L2", 90, r"^[0-9]{6}[0-9][MF<][0-9]{6}[0-9][A-Z]{3}", 28, 32, 3),
    ("TD1_L3", 85, r"^[A-Z]+<<[A-Z<]+$", 28, 32, 5),
    ("TD2_L1", 80, r"^[PVIAC][A-Z<][A-Z]{3}[A-Z]+<<[A-Z<]+$", 34, 38, 5),
    ("TD2_L2", 80, r"^[A-Z0-9<]{9}[0-9][A-Z]{3}[0-9]{6}[0-9][MF<][0-9]{6}[0-9]", 34, 38, 3),
    ("VISA_L1", 90, r"^V<[A-Z]{3}[A-Z]+<<[A-Z<]+$", 36, 46, 5),
)


def clean_line(line: Column) -> Column:
    return F.regexp_replace(F.upper(line), "[^A-Z0-9<]", "")


def line_type(line: Column) -> Column:
    """struct(line_type, score) of the first pattern that a cleaned line meets; null and 0 where none does."""
    n, fillers = F.length(line), F.length(line) - F.length(F.translate(line, "<", ""))
    found = F.when(~(n.between(28, 46) & (fillers >= 3) & line.contains("<<")), F.struct(F.lit(None).cast("string").alias("line_type"), F.lit(0).alias("score")))
    for name, score, pattern, least, most, needed in LINE_TYPES:
        found = found.when(line.rlike(pattern) & n.between(least, most) & (fillers >= needed), F.struct(F.lit(name).alias("line_type"), F.lit(score).alias("score")))
    return found.otherwise(F.struct(F.lit(None).cast("string").alias("line_type"), F.lit(0).alias("score")))


def cleanse(text: Column) -> Column:
    """Lines of recognized text as long as the first of 30, 36 or 44 characters with a filler."""
    lines = F.filter(F.split(F.translate(text, " ", ""), "\n"), lambda x: x.contains("<"))
    first = F.filter(F.transform(lines, F.length), lambda n: n.isin(30, 36, 44))
    return F.when(F.size(first) > 0, F.array_join(F.filter(lines, lambda x: F.length(x) >= F.get(first, 0)), "\n")).otherwise("")


def check_digit(value: Column) -> Column:
    """Sum of values (digits as they are, A = 10 ... Z = 35, others 0) weighted 7, 3, 1 in turn, modulo 10."""
    marks = F.filter(F.split(F.upper(value), ""), lambda c: c != "")

    def weighed(c: Column, i: Column) -> Column:
        worth = F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55).otherwise(0)
        return worth * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i % 3 + 1).cast("int"))

    return (F.aggregate(F.transform(marks, weighed), F.lit(0), lambda s, x: s + x) % 10).cast("string")


def pivot_date(six: Column, pivot: int = 69) -> Column:
    """YYMMDD as YYYY-MM-DD, years from the pivot on in the last century; unparsable values as they are."""
    yy = F.substring(six, 1, 2).cast("int")
    iso = F.concat(F.when(yy >= pivot, "19").otherwise("20"), F.substring(six, 1, 2), F.lit("-"), F.substring(six, 3, 2), F.lit("-"), F.substring(six, 5, 2))
    return F.when(six.rlike("^[0-9]{6}$") & F.try_to_date(iso, "yyyy-MM-dd").isNotNull(), iso).otherwise(six)


def plain_date(six: Column, past: bool) -> Column:
    """YYMMDD as YYYY-MM-DD without checks; past: years over 30 are of the last century.  Null unless all digits."""
    yy = F.substring(six, 1, 2)
    century = F.when(yy.cast("int") > 30, "19").otherwise("20") if past else F.lit("20")
    return F.when(six.rlike("^[0-9]{6}$"), F.concat(century, yy, F.lit("-"), F.substring(six, 3, 2), F.lit("-"), F.substring(six, 5, 2)))


def adjust_birth(birth: Column, expiry: Column) -> Column:
    """A birth year after the expiry year is a century too late."""
    b, e = F.substring(birth, 1, 4).try_cast("int"), F.substring(expiry, 1, 4).try_cast("int")
    return F.when(b > e, F.concat((b - 100).cast("string"), F.lit("-"), F.substring(birth, 6, 20))).otherwise(birth)


def bare(value: Column) -> Column:
    """Without fillers at the ends."""
    return F.regexp_replace(value, "^<+|<+$", "")


def name_parts(field: Column) -> tuple[Column, Column]:
    parts = F.split(field, "<<")
    tidy = lambda x: F.trim(F.translate(F.coalesce(x, F.lit("")), "<", " "))
    return tidy(F.get(parts, 0)), tidy(F.get(parts, 1))


def parse_strict(text: Column) -> dict[str, Column]:
    """Fields of two or three lines at fixed places, by name; status is FAILURE for anything else.

    The check booleans say what the digits of the document number, birth and expiry say.
    """
    lines = F.split(F.trim(text), "\n")
    one, two, three = F.get(lines, 0), F.get(lines, 1), F.get(lines, 2)
    two_lines, td1 = F.size(lines) == 2, F.size(lines) == 3
    at = lambda line, start, n: F.substring(line, start + 1, n)
    visa = at(one, 0, 1) == "V"
    kind = F.when(td1, "TD1").when(two_lines & two.endswith("<"), F.when(visa, "MRVA").otherwise("TD2")).when(two_lines, F.when(visa, "MRVB").otherwise("TD3"))
    issuer = at(one, 2, 3)
    failed = ~(two_lines | td1) | (two_lines & ~issuer.rlike(r"^\p{L}+$")) | text.isNull()
    surname, given = name_parts(F.when(td1, three).otherwise(F.substring(one, 6, 100)))
    birth_raw, expiry_raw = F.when(td1, at(two, 0, 6)).otherwise(at(two, 13, 6)), F.when(td1, at(two, 8, 6)).otherwise(at(two, 21, 6))
    number_raw = F.when(td1, at(one, 5, 9)).otherwise(at(two, 0, 9))
    expiry = pivot_date(expiry_raw)
    tail = F.when(kind == "TD2", 7).when(kind == "TD3", 14).when(kind == "MRVA", 16).otherwise(8)
    optional = F.when(td1, F.substring(one, 16, 100)).otherwise(two.substr(F.lit(29), tail))
    mark = lambda wide, narrow: F.when(td1, narrow).otherwise(wide)
    fields = {
        "mrz_type": kind,
        "document_code": bare(at(one, 0, 2)),
        "issuer_code": issuer,
        "surname": surname,
        "given_name": given,
        "document_number": bare(number_raw),
        "nationality_code": F.when(td1, at(two, 15, 3)).otherwise(at(two, 10, 3)),
        "birth_date": adjust_birth(pivot_date(birth_raw), expiry),
        "sex": F.when(td1, at(two, 7, 1)).otherwise(at(two, 20, 1)),
        "expiry_date": expiry,
        "optional_data": bare(optional),
        "number_check_ok": check_digit(number_raw) == mark(at(two, 9, 1), at(one, 14, 1)),
        "birth_check_ok": check_digit(birth_raw) == mark(at(two, 19, 1), at(two, 6, 1)),
        "expiry_check_ok": check_digit(expiry_raw) == mark(at(two, 27, 1), at(two, 14, 1)),
    }
    return {"status": F.when(failed, "FAILURE").otherwise("SUCCESS")} | {k: F.when(~failed, v) for k, v in fields.items()}


def parse_lenient(text: Column) -> dict[str, Column]:
    """Fields by the first line's length, of lines of 28 characters or more; what a line lacks is null."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 28)
    one, two, three = F.get(lines, 0), F.get(lines, 1), F.get(lines, 2)
    n = F.length(one)
    kind = F.when(F.size(lines) < 2, None).when(n >= 42, "TD3").when((F.size(lines) >= 3) & (n == 30), "TD1").when(n >= 34, "TD2")
    at = lambda line, start, length: F.substring(line, start + 1, length)
    plain = lambda x: F.trim(F.translate(x, "<", ""))
    names = F.when(kind == "TD1", three).when(kind == "TD3", F.substring(one, 6, 39)).when(kind == "TD2", F.substring(one, 6, 31))
    cut = F.when(names.contains("<<"), F.instr(names, "<<"))
    given = names.substr(cut + 2, F.length(names))
    return {
        "status": F.when(F.size(lines) > 0, "SUCCESS").otherwise("FAILED"),
        "mrz_type": kind,
        "document_type": F.when(kind == "TD3", at(one, 0, 1)).when(kind.isNotNull(), plain(at(one, 0, 2))),
        "country": F.when(kind.isNotNull(), at(one, 2, 3)),
        "surname": F.trim(F.translate(names.substr(F.lit(1), cut - 1), "<", " ")),
        "given_name": F.trim(F.translate(given, "<", " ")),
        "document_number": F.when(kind == "TD1", plain(at(one, 5, 9))).when(kind.isNotNull(), plain(at(two, 0, 9))),
        "nationality": F.when(kind == "TD1", at(two, 15, 3)).when(kind.isNotNull(), at(two, 10, 3)),
        "date_of_birth": F.when(kind == "TD1", plain_date(at(two, 0, 6), True)).when(kind == "TD3", plain_date(at(two, 13, 6), True)),
        "sex": F.when(kind == "TD1", at(two, 7, 1)).when(kind == "TD3", at(two, 20, 1)),
        "expiry_date": F.when(kind == "TD1", plain_date(at(two, 8, 6), False)).when(kind == "TD3", plain_date(at(two, 21, 6), False)),
    }


def to_text(fields: dict[str, Column], raw: Column) -> Column:
    """Readable lines of a parsed document for search; empty if it failed."""
    labels = {
        "Document Type": ("document_type", "document_code"), "Country": ("country", "issuer_code"), "Surname": ("surname",), "Given Name": ("given_name",),
        "Document Number": ("document_number",), "Nationality": ("nationality", "nationality_code"), "Date of Birth": ("date_of_birth", "birth_date"),
        "Sex": ("sex",), "Expiry Date": ("expiry_date",), "Optional Data": ("optional_data",),
    }
    said = lambda v: F.when(F.trim(v) != "", v)
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(*[said(fields[k]) for k in keys if k in fields])) for label, keys in labels.items() if any(k in fields for k in keys)]
    text = F.concat_ws("\n", F.lit("[Passport/ID Document]"), *lines, F.concat(F.lit("\nRaw MRZ:\n"), raw))
    return F.when(fields["status"].isin("SUCCESS", "WARNING"), text).otherwise("")
