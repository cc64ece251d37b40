"""Field normalisation as column expressions.

Every parser returns a :class:`Field`: a typed value and an error text (null when the field is fine),
so a bad cell never aborts the job under ANSI mode; validation decides what happens with the errors.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The recognised input columns, by logical field, in order of preference.
ALIASES: dict[str, list[str]] = {
    "tx_id": ["tx_id", "txid", "txId", "transaction_id", "id"],
    "label": ["class", "label", "target"],
    "time_step": ["time_step", "timestep", "step"],
    "input_addresses": ["input_addresses", "inputs"],
    "output_addresses": ["output_addresses", "outputs"],
    "input_amounts": ["input_amounts", "input_satoshis"],
    "output_amounts": ["output_amounts", "output_satoshis"],
    "src_ip": ["src_ip", "source_ip"],
    "dst_ip": ["dst_ip", "destination_ip"],
    "src_port": ["src_port", "source_port"],
    "dst_port": ["dst_port", "destination_port"],
    "timestamp": ["timestamp", "time"],
    "parent_tx_ids": [
        "parent_tx_ids", "parent_tx_id", "source_tx_ids", "source_tx_id", "prev_tx_ids", "prev_tx_id",
    ],
    "exchange_addresses": ["exchange_addresses", "exchange_address"],
}
RECOGNISED = {name for names in ALIASES.values() for name in names}

# Label spellings, autonomous systems treated as risky, ledger constants.
LABELS = {
    "illicit": ["1", "illicit", "class-1"],
    "licit": ["2", "licit", "class-2"],
    "unknown": ["3", "unknown", "class-3"],
}
RISKY_ASN_DESCRIPTIONS = ["Tor Transit", "NForce Entertainment B.V.", "M247 Europe SRL"]
SATS_PER_BTC = 100_000_000
TIME_STEPS = 49
STEP_SECONDS = 600
FIRST_STEP_EPOCH = 1_724_889_600  # 2024-08-29T00:00:00Z
DEFAULT_PORT = 8333
SURROGATE_SALT = "coinweave"

# The amount rule for rows without amounts, in satoshis.
INPUT_BASE, INPUT_STEP, INPUT_STEPS = 120_000_000, 2_000_000, 500
PAYMENT_BASE, PAYMENT_STEP, PAYMENT_STEPS = 8_000_000, 50_000, 3
FEE, SINGLE_FEE = 15_000, 10_000


def _no_error() -> Column:
    return F.lit(None).cast("string")


class Field(NamedTuple):
    value: Column
    error: Column


# ---------------------------------------------------------------- aliases and labels


def first_present(df: DataFrame, names: list[str], default: Column | None = None) -> Column:
    """First alias that is neither null nor the empty string (no trimming)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    present = [n for n in names if n in types]
    is_array = any(isinstance(types[n], T.ArrayType) for n in present)
    options = []
    for n in present:
        c = F.col(f"`{n}`")
        if isinstance(types[n], T.ArrayType):
            options.append(c.cast("array<string>"))
        elif is_array:
            options.append(split_list(c.cast("string")))
        else:
            text = c.cast("string")
            options.append(F.when(text != "", text))
    if default is not None:
        options.append(default)
    if not options:
        return F.lit(None).cast("string")
    return F.coalesce(*options)


def normalize_label(c: Column) -> Field:
    text = F.lower(F.trim(c))
    value = F.lit(None).cast("string")
    for label, spellings in LABELS.items():
        value = F.when(text.isin(spellings), F.lit(label)).otherwise(value)
    return Field(value, unreadable(c, value, "label is not recognised: "))


# ---------------------------------------------------------------- lists and amounts


def split_list(c: Column) -> Column:
    """JSON array text, or text separated by ``;`` or ``|`` whose blank parts are dropped."""
    parts = F.filter(F.transform(F.split(c, "[;|]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(parts)


def parse_list(c: Column, native: bool = False) -> Field:
    empty = F.array().cast("array<string>")
    if native:
        return Field(F.coalesce(c, empty), _no_error())
    parsed = split_list(c)
    broken = c.isNotNull() & (F.trim(c) != "") & parsed.isNull()
    return Field(
        F.when(c.isNull() | (F.trim(c) == ""), empty).otherwise(F.coalesce(parsed, empty)),
        F.when(broken, F.concat(F.lit("list is not readable: "), c)),
    )


def _whole(item: Column) -> Column:
    """The integer a cell stands for; null where it has another fraction than zeros, or is too large."""
    text = F.trim(item)
    plain = F.regexp_extract(text, r"^([+-]?\d+)(?:\.0*)?$", 1)
    # An exponent moves the point; such a number is exact as a decimal if nothing is left behind the point.
    moved = F.when(text.rlike("[eE]"), text.try_cast("decimal(38,18)"))
    exact = F.when(moved == F.floor(moved), moved.try_cast("decimal(38,0)"))
    return F.when(plain != "", plain.try_cast("decimal(38,0)")).otherwise(exact).try_cast("bigint")


def _fraction(item: Column) -> Column:
    text = F.trim(item)
    moved = text.try_cast("decimal(38,18)")
    return F.when(text.rlike("[eE]"), F.coalesce(moved != F.floor(moved), F.lit(False))).otherwise(text.rlike(r"\.0*[1-9]"))


def parse_amounts(c: Column, native: bool = False) -> Field:
    """Exact satoshi amounts: every item integral, non-negative and within 64 bits."""
    items, list_error = parse_list(c, native)

    def check(rows: Column) -> Column:
        def first_failing(test, text: str) -> Column:
            bad = F.filter(rows, test)
            return F.when(F.size(bad) > 0, F.concat(F.lit(text), F.coalesce(F.get(bad, F.lit(0))["t"], F.lit("null"))))

        return F.coalesce(
            first_failing(lambda x: F.coalesce(F.isnan(x["d"]) | (F.abs(x["d"]) == float("inf")), F.lit(True)), "amount is not numeric: "),
            first_failing(lambda x: x["f"], "amount is not an integer: "),
            first_failing(lambda x: x["d"] < 0, "amount is negative: "),
            first_failing(lambda x: x["w"].isNull(), "amount is too large: "),
        )

    read = F.transform(items, lambda x: F.struct(x.alias("t"), F.trim(x).try_cast("double").alias("d"), _fraction(x).alias("f"), _whole(x).alias("w")))
    error = F.coalesce(list_error, let(read, check))
    # Values of cells with an error are only for the reader of the report.
    return Field(F.transform(items, lambda x: F.coalesce(_whole(x), F.trim(x).try_cast("decimal(38,10)").try_cast("bigint"))), error)


def sats_to_btc(c: Column) -> Column:
    return c / F.lit(float(SATS_PER_BTC))


def total(amounts: Column) -> Column:
    """Sum of amounts; null where it leaves 64 bits."""
    return F.aggregate(amounts, F.lit(0).cast("bigint"), lambda acc, x: F.try_add(acc, x))


# ---------------------------------------------------------------- network fields

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_HEX = "[0-9a-f]{1,4}"


def ipv4_to_long(c: Column) -> Column:
    parts = F.split(c, r"\.")
    value = F.lit(0).cast("bigint")
    for i in range(4):
        value = value * 256 + F.get(parts, F.lit(i)).try_cast("bigint")
    return F.when(c.rlike(IPV4_PATTERN), value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once: the expression tree grows by one copy, not by uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ipv6_groups(c: Column) -> Column:
    """The eight hexadecimal groups of an IPv6 literal, null when it is not one. All built-in expressions."""
    none = F.array().cast("array<string>")
    words = lambda half: F.when(half == "", none).otherwise(F.split(half, ":"))

    def dotted_tail(text: Column) -> Column:
        """A dotted tail stands for two hexadecimal groups."""

        def rewrite(tail: Column) -> Column:
            high, low = F.shiftright(ipv4_to_long(tail), 16), ipv4_to_long(tail).bitwiseAND(F.lit(65535))
            groups = F.concat_ws(":", F.lower(F.hex(high)), F.lower(F.hex(low)))
            valid = tail.rlike(IPV4_PATTERN)
            return F.when(tail == "", text).when(valid, F.concat(F.regexp_replace(text, "[0-9.]*$", ""), groups))

        return let(F.regexp_extract(text, r":([0-9.]*[.][0-9.]*)$", 1), rewrite)

    def expand(plain: Column) -> Column:
        """Eight groups, "::" filled with zeros; null when the text has no such reading."""

        def fill(halves: Column) -> Column:
            head, rest = words(F.get(halves, F.lit(0))), words(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
            missing = 8 - F.size(head) - F.size(rest)
            whole = F.when((F.size(halves) == 1) & (missing == 0), head).when(
                (F.size(halves) == 2) & (missing > 0),
                F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), rest),
            )
            return let(whole, lambda g: F.when(F.forall(g, lambda x: x.rlike(f"^{_HEX}$")), g))

        return let(F.split(plain, "::"), fill)

    return let(let(F.lower(c), dotted_tail), expand)


def _canonical_ipv6(c: Column) -> Column:
    """RFC 5952 text of an IPv6 literal, null when it is not one; IPv4-mapped ones end in dotted form."""

    def compress(short: Column) -> Column:
        """The longest run of zero groups (two or more, the first of equals) becomes "::"."""
        packed = F.regexp_replace(short, "^:|:$", "")
        for n in range(2, 9):
            run = ":" + "0:" * n
            at = F.instr(short, run)
            before = F.regexp_replace(F.substring(short, F.lit(2), F.greatest(at - 2, F.lit(0))), ":$", "")
            after = F.regexp_replace(F.substring(short, at + len(run), F.length(short)), ":$", "")
            packed = F.when(at > 0, F.concat(before, F.lit("::"), after)).otherwise(packed)
        return packed

    def shorten(groups: Column) -> Column:
        bare = F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
        framed = F.concat(F.lit(":"), F.array_join(bare, ":"), F.lit(":"))
        return F.when(groups.isNotNull(), let(framed, compress))

    def dotted(plain: Column) -> Column:
        number = lambda i: F.conv(F.regexp_extract(plain, _MAPPED, i), 16, 10).cast("int")
        octets = [f(number(i)) for i in (1, 2) for f in (lambda x: F.shiftright(x, 8), lambda x: x % 256)]
        return F.when(plain.rlike(_MAPPED), F.concat(F.lit("::ffff:"), F.concat_ws(".", *octets))).otherwise(plain)

    return let(let(ipv6_groups(c), shorten), dotted)


_MAPPED = f"^::ffff:({_HEX}):({_HEX})$"
#: A zone at the end of an address names an interface; it is kept as written.
_ZONE = "%[^%/]+$"


def ip_value(c: Column) -> Column:
    """Standard text of an address of either family, null when it is none."""
    text = F.trim(c)
    whole = F.concat(_canonical_ipv6(F.regexp_replace(text, _ZONE, "")), F.regexp_extract(text, f"({_ZONE[:-1]})$", 1))
    return F.when(text.rlike(IPV4_PATTERN), text).when(text.contains(":"), whole)


#: Bits before an IPv4 address inside IPv6.
MAPPED_BITS = 96


def ip_key(c: Column) -> Column:
    """The 16 bytes of an address as two numbers (high, low); an IPv4 address stands at its mapped place, and a zone
    is left out. Null when the text is no address."""
    text = F.trim(c)

    def half(groups: Column, first: int) -> Column:
        value = F.lit(0).cast("bigint")
        for i in range(first, first + 4):
            value = F.shiftleft(value, 16).bitwiseOR(F.conv(F.get(groups, F.lit(i)), 16, 10).cast("bigint"))
        return value

    four = F.struct(F.lit(0).cast("bigint").alias("high"), ipv4_to_long(text).bitwiseOR(F.lit(0xFFFF << 32)).alias("low"))
    six = let(
        ipv6_groups(F.regexp_replace(text, _ZONE, "")),
        lambda g: F.when(g.isNotNull(), F.struct(half(g, 0).alias("high"), half(g, 4).alias("low"))),
    )
    return F.when(text.rlike(IPV4_PATTERN), four).when(text.contains(":"), six)


def unreadable(c: Column, value: Column, text: str) -> Column:
    """Error text for a present cell without a value."""
    return F.when(c.isNotNull() & value.isNull(), F.concat(F.lit(text), c))


def ip_error(c: Column, value: Column, name: str) -> Column:
    return unreadable(c, value, f"{name} is not an IP address: ")


def normalize_ip(c: Column, name: str = "ip") -> Field:
    value = ip_value(c)
    return Field(value, ip_error(c, value, name))


def _bounded_int(c: Column, name: str, low: int, high: int) -> Field:
    number = F.trim(c).try_cast("double")
    integral = number == F.floor(number)
    inside = number.between(low, high)
    error = (
        F.when(c.isNull(), _no_error())
        .when(number.isNull(), F.concat(F.lit(f"{name} is not numeric: "), c))
        .when(~F.coalesce(integral, F.lit(False)), F.concat(F.lit(f"{name} is not an integer: "), c))
        .when(~inside, F.concat(F.lit(f"{name} is outside {low}-{high}: "), c))
    )
    return Field(F.when(error.isNull(), number.try_cast("int")), error)


def normalize_port(c: Column, name: str = "port") -> Field:
    return _bounded_int(c, name, 0, 65535)


def normalize_time_step(c: Column) -> Field:
    return _bounded_int(c, "time_step", 1, TIME_STEPS)


# ---------------------------------------------------------------- time


def normalize_timestamp(c: Column) -> Field:
    """Epoch seconds or ISO-8601 (basic or extended, to the hour at least or a date); a missing zone means UTC,
    whatever the session time zone is."""
    text = F.trim(c)
    seconds = text.try_cast("double")
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})[T ](\d{2})(?:(\d{2})(\d{2})?)?", "$1-$2-$3T$4:$5:$6")
    text = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2})(?::{1,2}(?!\d)|(?=Z|[+-]|$))", "$1T$2:00:00")
    text = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(?::(?!\d)|(?=Z|[+-]|$))", "$1T$2:00")
    from_epoch = F.timestamp_micros(F.round(seconds * 1_000_000).try_cast("bigint"))
    dated = text.rlike(r"^\d{4}-\d{2}-\d{2}")
    zoned = (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z")))
        .when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text)
        .otherwise(F.concat(text, F.lit("Z")))
    )
    value = F.when(seconds.isNotNull(), from_epoch).when(dated, zoned.try_cast("timestamp"))
    return Field(value, unreadable(c, value, "timestamp is not readable: "))


def timestamp_from_step(step: Column, offset_seconds: Column) -> Column:
    """Start of a time step (ten minutes each) plus an offset."""
    return F.timestamp_seconds(F.lit(FIRST_STEP_EPOCH) + (step - 1) * STEP_SECONDS + offset_seconds)


def default_time_step(index: Column) -> Column:
    return (F.pmod(index, F.lit(TIME_STEPS)) + 1).cast("int")


def surrogate_key(index: Column, salt: str = SURROGATE_SALT) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), index.cast("string")), 256)
    return F.concat(F.lit("txid_"), F.substring(digest, 1, 24))


# ---------------------------------------------------------------- small classifiers


def script_type(address: Column) -> Column:
    return F.when(address.startswith("bc1"), F.lit("bech32")).otherwise(F.lit("base58"))


def risky_asn_flag(description: Column, risky: list[str] = RISKY_ASN_DESCRIPTIONS) -> Column:
    return F.coalesce(description.isin(risky), F.lit(False))


def remap_class(c: Column) -> Column:
    """Dataset classes '1', '2', 'unknown' as 1, 0, -1."""
    return F.when(c == "1", F.lit(1)).when(c == "2", F.lit(0)).when(c == "unknown", F.lit(-1))


def flag_equals(c: Column, value) -> Column:
    return F.coalesce((c == F.lit(value)).cast("int"), F.lit(0))


# ---------------------------------------------------------------- anonymous features


def ext_feature_summary(df: DataFrame) -> dict[str, Column]:
    """Count, mean and population deviation over all unrecognised cells that read as numbers."""
    extra = [
        F.col(f"`{f.name}`").cast("string")
        for f in df.schema.fields
        if f.name not in RECOGNISED and not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
    ]
    if not extra:
        nothing = F.lit(None).cast("double")
        return {"ext_feature_count": nothing, "ext_feature_mean": nothing, "ext_feature_std": nothing}
    numbers = F.filter(F.array(*[F.trim(c).try_cast("double") for c in extra]), lambda x: x.isNotNull())
    n = F.size(numbers).cast("double")

    def fold(f) -> Column:
        return F.aggregate(numbers, F.lit(0.0), f)

    mean = F.when(n > 0, fold(lambda acc, x: acc + x) / n)
    spread = F.when(n > 0, F.sqrt(fold(lambda acc, x: acc + (x - mean) * (x - mean)) / n))
    return {
        "ext_feature_count": F.when(n > 0, n),
        "ext_feature_mean": mean,
        "ext_feature_std": spread,
    }


# ---------------------------------------------------------------- missing amounts


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def impute_inputs(amounts: Column, addresses: Column, index: Column) -> Column:
    """Missing input amounts: an index-dependent total split evenly over the addresses."""
    whole = F.lit(INPUT_BASE).cast("bigint") + F.pmod(index, F.lit(INPUT_STEPS)) * INPUT_STEP
    n = F.size(addresses)
    share = _div(whole, F.greatest(n, F.lit(1)))
    return F.when((F.size(amounts) == 0) & (n > 0), F.array_repeat(share, n)).otherwise(amounts)


def impute_outputs(amounts: Column, addresses: Column, inputs: Column, index: Column) -> Column:
    """Missing output amounts: equal capped payments and a change output that leaves the fee."""
    available = total(inputs)
    n = F.size(addresses)
    one = F.lit(1).cast("bigint")
    payments = n - 1
    payment = F.least(
        F.lit(PAYMENT_BASE).cast("bigint") + F.pmod(index, F.lit(PAYMENT_STEPS)) * PAYMENT_STEP,
        F.greatest(_div(available - FEE, F.greatest(n, F.lit(1))), one),
    )
    change = F.greatest(available - payment * payments - FEE, one)
    single = F.array(F.greatest(available - SINGLE_FEE, one))
    several = F.concat(F.array_repeat(payment, F.greatest(payments, F.lit(0))), F.array(change))
    filled = F.when(n == 1, single).otherwise(several)
    return F.when((F.size(amounts) == 0) & (n > 0), filled).otherwise(amounts)
