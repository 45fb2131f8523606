"""Labels, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.functions.nulls import as_col


def title(c: Column | str) -> Column:
    """Title case that also starts a new word after ``-`` and ``/``."""

    def parts(text: Column, mark: str, inner) -> Column:
        return F.array_join(F.transform(F.split(text, mark), inner), mark)

    return parts(as_col(c), "-", lambda p: parts(p, "/", F.initcap))


def school_name(c: Column | str) -> Column:
    """The name with exactly one trailing " School"."""
    return F.concat(F.regexp_replace(as_col(c), " School$", ""), F.lit(" School"))


def file_safe(c: Column | str) -> Column:
    return F.replace(as_col(c), F.lit("/"), F.lit("-"))


def output_path(
    county: Column | str,
    district: Column | str,
    school_type: Column | str,
    school: Column | str,
    root: str = "school_maps",
    suffix: str = ".pdf",
) -> Column:
    return F.concat(
        F.lit(root + "/"),
        title(county),
        F.lit(" County/"),
        as_col(district),
        F.lit(" School District/"),
        file_safe(school_type),
        F.lit("s/"),
        file_safe(school),
        F.lit(suffix),
    )


def number_text(c: Column | str) -> Column:
    """A number as text, without ``.0`` for whole values."""
    c = as_col(c)
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def rounded_text(c: Column | str, digits: int = 0) -> Column:
    """Half-even rounding as text."""
    return number_text(F.bround(as_col(c), digits))


def pct_label(c: Column | str, digits: int = 0, signed: bool = True) -> Column:
    """``0.12`` -> ``+12%``; the sign is shown only for an increase."""
    c = as_col(c)
    body = F.concat(rounded_text(c * 100, digits), F.lit("%"))
    if not signed:
        return body
    return F.concat(F.when(c > 0, "+").otherwise(""), body)


def wrap_text(c: Column | str, width: int = 30) -> Column:
    """Break at blanks so that no line is longer than ``width`` unless one word is."""
    flat = F.trim(F.regexp_replace(as_col(c), r"\s+", " "))
    return F.rtrim(
        F.regexp_replace(flat, rf"(.{{1,{width}}})( |$)", "$1\n"), F.lit("\n")
    )


def _text(c: Column | str, missing: str = "NA") -> Column:
    return F.coalesce(as_col(c).cast("string"), F.lit(missing))


# --- fixed values: tooltip wording --------------------------------------------------------
_POINT = {"en": ("", " age: ", "unknown age"), "es": ("edad de ", ": ", "edad desconocida")}
_COUNTY = {
    "en": (
        "<b>", " County</b></br>",
        "population: ",
        "average crashes per year: ",
        "average crashes/year per 100k residents: ",
    ),
    "es": (
        "<b>Condado de ", "</b></br>",
        "población: ",
        "choques promedio por año: ",
        "choques promedio/año por cada 100.000 habitantes: ",
    ),
}
_SCHOOL = {
    "en": ("<b>", " School</b></br>", "", " School District</br>"),
    "es": ("<b>Escuela ", "</b></br>", "Distrito Escolar ", "</br>"),
}
# ----------------------------------------------------------------------------------------


def point_tooltip(role, date, severity, age, lang: str = "en") -> Column:
    """Hover text of a crash point."""
    before, after, unknown = _POINT[lang]
    role = F.coalesce(as_col(role), F.lit(""))
    return F.concat(
        F.lit("<b>"), title(role), F.lit(" </b><br>"),
        _text(date), F.lit("</br>"),
        _text(severity), F.lit("</br>"),
        F.lit(before), role, F.lit(after), F.coalesce(number_text(age), F.lit(unknown)),
    )


def county_tooltip(county, population, mean_crashes, rate, lang: str = "en") -> Column:
    """Hover text of a county polygon."""
    start, end, pop, mean, per = _COUNTY[lang]
    return F.concat(
        F.lit(start), title(county), F.lit(end),
        F.lit(pop), F.coalesce(F.format_number(as_col(population), 0), F.lit("NA")), F.lit("<br>"),
        F.lit(mean), F.coalesce(rounded_text(mean_crashes), F.lit("NA")), F.lit("</br>"),
        F.lit(per), F.coalesce(rounded_text(rate), F.lit("NA")),
    )


def school_tooltip(school, district, school_type, lang: str = "en") -> Column:
    """Hover text of a school marker."""
    a, b, c, d = _SCHOOL[lang]
    return F.concat(
        F.lit(a), _text(school), F.lit(b), F.lit(c), _text(district), F.lit(d), _text(school_type)
    )
