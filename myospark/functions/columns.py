"""Column expressions of the biosignal formats: scaling, gains, names. All run inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the OTB+ format: supply voltage, and defaults of a header without the attribute.
SUPPLY_VOLTS, DEVICE, RATE, BITS, CHANNELS = 4.8, "UnknownDevice", 2000.0, 16, 128
#: File types by suffix.
FILE_TYPES = {".mat": "mat", ".otb+": "otb", ".otb": "otb", ".otb4": "otb4"}


def time_axis(sample: Column, rate: Column | float) -> Column:
    """Seconds from the first sample."""
    return sample.cast("double") / (F.lit(rate) if isinstance(rate, (int, float)) else rate)


def single(x: Column) -> Column:
    """Rounded to single precision."""
    return x.cast("float").cast("double")


def suffix(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)


def file_type(path: Column) -> Column:
    """mat, otb or otb4; null for other suffixes."""
    return reduce(lambda c, kv: c.when(suffix(path) == kv[0], kv[1]), FILE_TYPES.items(), F.when(F.lit(False), ""))


def otb_scale(x: Column, gain: Column, bits: Column | int = BITS) -> Column:
    """Millivolts of OTB+ counts; a gain of 0 counts as 1."""
    steps = F.pow(F.lit(2.0), F.lit(bits) if isinstance(bits, int) else bits)
    return x.cast("double") * F.lit(SUPPLY_VOLTS) / steps * 1000.0 / F.when(gain == 0, F.lit(1.0)).otherwise(gain.cast("double"))


def otb4_scale(x: Column, volts: Column, bits: Column, gain: Column) -> Column:
    """Millivolts of OTB4 counts: the factor first. A gain of 0 is an error."""
    factor = volts.cast("double") / F.pow(F.lit(2.0), bits.cast("double")) * 1000.0 / gain.cast("double")
    return F.when(gain == 0, F.raise_error(F.lit("a track's gain is 0")).cast("double")).otherwise(x.cast("double") * factor)


def effective_gain(adapter: Column, channel: Column) -> Column:
    """A channel without a gain of its own has its adapter's, which then counts twice."""
    return adapter * F.coalesce(channel, adapter)


#: White space at either end of a text.
ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def channel_description(*parts: Column) -> Column:
    """The parts that say something, joined by hyphens. Padded placeholders are kept, trimmed."""
    strip = lambda x: F.regexp_replace(x, ENDS, "")
    given = F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "not defined") & (strip(x) != ""))
    return F.array_join(F.transform(given, strip), "-")


def track_description(device: Column, path: Column, subtitle: Column, channel: Column) -> Column:
    return F.format_string("%s-%s-%s-ch%d", device, path, subtitle, channel)


def entry_text(raw: Column) -> Column:
    """Bytes as text: UTF-8 if they are valid, else Latin-1."""
    return F.when(F.is_valid_utf8(raw), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))


def fresh(written: Column, now: Column, days: int = 7) -> Column:
    """Whether a cached file is younger than the limit."""
    return F.unix_timestamp(now) - F.unix_timestamp(written) < days * 86400
