"""Text labels, all as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.geo import round_half_up

SEPARATOR = " · "
#: Stands for a figure that there is not.
NONE = "—"
#: Minutes of one unit of a typed duration.
UNIT_MINUTES = {"minutes": 1.0, "hours": 60.0, "days": 1440.0}
#: Fragments of sign-in errors and the texts shown for them.
SIGN_IN_ERRORS = {
    "Invalid login credentials": "Incorrect email or password.",
    "Email not confirmed": "Please confirm your email before signing in.",
    "User already registered": "An account with this email already exists.",
    "Password should be": "Password must be at least 8 characters.",
}


#: Names of the state codes that trails use.
STATE_NAMES = {
    "AL": "Alabama", "AZ": "Arizona", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia",
    "ID": "Idaho", "MA": "Massachusetts", "MD": "Maryland", "ME": "Maine", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MT": "Montana",
    "NC": "North Carolina", "ND": "North Dakota", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "OH": "Ohio", "OR": "Oregon",
    "PA": "Pennsylvania", "TN": "Tennessee", "VA": "Virginia", "VT": "Vermont", "WA": "Washington", "WI": "Wisconsin", "WV": "West Virginia", "WY": "Wyoming",
}


def state_name(code: Column) -> Column:
    """Name of a state's code; an unknown code stands for itself."""
    names = F.create_map(*[F.lit(x) for pair in STATE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def to_fixed(x: Column, places: int) -> Column:
    """Text with fixed decimals, of the double's exact binary value, ties away from zero.

    Spark's own formatters round the shortest decimal text of a double instead, and so differ on
    ties: 0.35 is a little less than it looks and gives 0.3. The fraction is taken as two whole
    numbers of 40 bits each, which hold it exactly (what lies below rounds to nothing), and is
    rounded in whole decimals. Null and NaN give null; places are 1 to 6, and x is below 2**63.
    """
    a = F.abs(x.cast("double"))
    f = a - F.floor(a)
    high = F.floor(f * F.lit(2.0**40))
    low = F.floor((f * F.lit(2.0**40) - high) * F.lit(2.0**40))
    whole = lambda n: F.lit(str(n)).cast(f"decimal({len(str(n))},0)")
    bits = high.cast("decimal(13,0)") * whole(2**40) + low.cast("decimal(13,0)")
    units = F.call_function("div", bits * whole(2 * 10**places) + whole(2**80), whole(2**81))
    carried = units >= 10**places
    text = F.concat(
        F.when(x < 0, F.lit("-")).otherwise(F.lit("")), (F.floor(a) + carried.cast("long")).cast("string"), F.lit("."),
        F.lpad((units % 10**places).cast("string"), places, "0"),
    )
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), text)


def fixed_number(x: Column, places: int) -> Column:
    """The number that the fixed text reads as."""
    return to_fixed(x, places).cast("double")


def thousands(x: Column) -> Column:
    """Digits in groups of three, with up to three decimals and no idle zeros."""
    text = to_fixed(x, 3)
    head = F.regexp_replace(F.substring_index(text, ".", 1), r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")
    tail = F.rtrim(F.substring_index(text, ".", -1), F.lit("0"))
    return F.concat(head, F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(F.lit("")))


def date_label(d: Column) -> Column:
    return F.date_format(d, "MMM d, yyyy")


def percent_label(pct: Column) -> Column:
    """One decimal; '<0.1' for small shares."""
    return F.when(pct < 0.1, F.lit("<0.1")).otherwise(to_fixed(pct, 1))


def card_text(miles: Column, total: Column, pct: Column) -> Column:
    """Line of a trail's card: '5.0 of 2,198 mi — 0.2%', or '0 of 2,198 mi' where nothing was walked."""
    some = F.concat(to_fixed(miles, 1), F.lit(" of "), thousands(total), F.lit(" mi — "), percent_label(pct), F.lit("%"))
    return F.when(miles > 0, some).otherwise(F.concat(F.lit("0 of "), thousands(total), F.lit(" mi")))


def panel_percent(pct: Column) -> Column:
    """Share in the panel of a trail, a dash where there is none."""
    return F.when(pct > 0, F.concat(percent_label(pct), F.lit("%"))).otherwise(F.lit(NONE))


def states_label(states: Column) -> Column:
    """A single state as it is, several as their number and list."""
    return F.when(F.size(states) == 1, states[0]).otherwise(F.concat(F.size(states).cast("string"), F.lit(" ("), F.array_join(states, SEPARATOR), F.lit(")")))


def segment_summary(miles: Column, lo: Column, hi: Column, states: Column) -> Column:
    """'5.0 mi · Mile 1.0 → 6.0 · CT', or '~5.0 mi' where a marker is missing."""
    spans = F.concat(to_fixed(miles, 1), F.lit(" mi · Mile "), to_fixed(F.least(lo, hi), 1), F.lit(" → "), to_fixed(F.greatest(lo, hi), 1))
    main = F.when(lo.isNotNull() & hi.isNotNull(), spans).otherwise(F.concat(F.lit("~"), to_fixed(miles, 1), F.lit(" mi")))
    return F.concat_ws(SEPARATOR, main, F.nullif(states, F.lit("")))


def popup(lo: Column, hi: Column, states: Column, date: Column) -> Column:
    """Lines of a map popup, 'Mile 1.0 → 6.0 (5.0 mi)', states and date as it is; absent parts are left out."""
    span = F.concat(F.lit("Mile "), to_fixed(F.least(lo, hi), 1), F.lit(" → "), to_fixed(F.greatest(lo, hi), 1), F.lit(" ("), to_fixed(F.abs(hi - lo), 1), F.lit(" mi)"))
    return F.concat_ws("\n", F.when(lo.isNotNull() & hi.isNotNull(), span), F.nullif(states, F.lit("")), date.cast("string"))


def state_option(name: Column, lo: Column, hi: Column) -> Column:
    """Entry of a list of states; the miles are left out where there are none."""
    return F.concat(name, F.coalesce(F.concat(F.lit(" (Miles "), round_half_up(lo).cast("string"), F.lit("–"), round_half_up(hi).cast("string"), F.lit(")")), F.lit("")))


def parse_number(text: Column) -> Column:
    """The number that a text starts with, else null."""
    return F.regexp_extract(F.trim(text), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0).try_cast("double")


def duration_minutes(text: Column, unit: Column) -> Column:
    """Whole minutes of a typed duration; empty or unreadable is null, '0' is 0."""
    factor = F.coalesce(*[F.when(unit == k, F.lit(v)) for k, v in UNIT_MINUTES.items()])
    return round_half_up(parse_number(text) * factor).cast("int")


def friendly_error(message: Column, mapping: dict[str, str] | None = None) -> Column:
    """The text for the first fragment that the message contains, in its case, else the message itself."""
    return F.coalesce(*[F.when(F.contains(message, F.lit(k)), F.lit(v)) for k, v in (mapping or SIGN_IN_ERRORS).items()], message)


def merge_border_state(state: Column) -> Column:
    """Points of either side of the shared ridge carry one code."""
    return F.when(state.isin("NC", "TN"), F.lit("NC-TN")).otherwise(state)


def valid_username(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[a-zA-Z0-9_-]{3,30}\z"), F.lit(False))
