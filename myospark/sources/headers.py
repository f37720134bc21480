"""Headers of OTB recordings as relations: XML texts are parsed by Spark's own functions, and their adapters, channels and tracks joined and exploded.

What the readers' parsers say of one file, this says of a column of headers, without Python. Texts that aren't XML are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from myospark.functions import columns as C
from myospark.operators.tracks import track_channels
from myospark.sources.otb4 import RATE

OPTIONS = {"attributePrefix": "_", "ignoreSurroundingSpaces": "false", "mode": "FAILFAST"}


def struct_of(names: list[str], more: str = "") -> str:
    return f"struct<{','.join(f'{n}:string' for n in names)}{',' if more else ''}{more}>"


CHANNEL = struct_of(["_Index", "_Gain", "_ID", "_Prefix", "_Description", "_Muscle", "_Side"])
ADAPTER = struct_of(["_ID", "_Type", "_Gain", "_ChannelStartIndex", "_Description"], f"Channel:array<{CHANNEL}>")
DEVICE = struct_of(["_Name", "_SampleFrequency", "_ad_bits", "_DeviceTotalChannels"], f"Channels:array<struct<Adapter:array<{ADAPTER}>>>")
TRACKS = f"struct<TrackInfo:array<{struct_of(['Device', 'Gain', 'ADC_Nbits', 'ADC_Range', 'SamplingFrequency', 'SignalStreamPath', 'NumberOfChannels', 'AcquisitionChannel', 'SubTitle'])}>>"


def number(text: Column, default: Column | float | int, kind: str = "double") -> Column:
    return F.coalesce(F.trim(F.nullif(text, F.lit(""))).cast(kind), default if isinstance(default, Column) else F.lit(default).cast(kind))


def otb_devices(headers: DataFrame, file: str, xml: str = "xml") -> DataFrame:
    """(file, device, sampling_frequency, bits, channels) of OTB+ headers. A number of channels that can't be read or isn't positive is the default."""
    parsed = headers.select(file, F.from_xml(F.col(xml), DEVICE, OPTIONS).alias("d"))
    total = F.trim("d._DeviceTotalChannels").try_cast("int")
    return parsed.select(
        file, F.coalesce("d._Name", F.lit(C.DEVICE)).alias("device"), number(F.col("d._SampleFrequency"), C.RATE).alias("sampling_frequency"), number(F.col("d._ad_bits"), C.BITS, "int").alias("bits"),
        F.when(total > 0, total).otherwise(C.CHANNELS).alias("channels"),
    )


def otb_channels(headers: DataFrame, file: str, xml: str = "xml") -> DataFrame:
    """(file, channel_idx, adapter_id, adapter_type, gain, description) of OTB+ headers. Of several entries for a channel the last one counts."""
    parsed = headers.select(file, F.from_xml(F.col(xml), DEVICE, OPTIONS).alias("d"))
    adapters = parsed.select(file, F.posexplode(F.flatten(F.transform("d.Channels", lambda c: F.coalesce(c["Adapter"], F.array().cast(f"array<{ADAPTER}>"))))).alias("a", "adapter"))
    each = adapters.select(file, "a", "adapter", F.posexplode("adapter.Channel").alias("c", "channel"))
    gain, of = number(F.col("adapter._Gain"), 1.0), lambda names: [F.col(n) for n in names]
    entry = F.struct(
        F.col("adapter._ID").alias("adapter_id"), F.coalesce("adapter._Type", "adapter._ID").alias("adapter_type"), C.effective_gain(gain, number(F.col("channel._Gain"), gain)).alias("gain"),
        C.channel_description(*of(["adapter._ID", "adapter._Description", "channel._ID", "channel._Prefix", "channel._Description", "channel._Muscle", "channel._Side"])).alias("description"),
    )
    at = number(F.col("adapter._ChannelStartIndex"), 0, "int") + number(F.col("channel._Index"), 0, "int")
    last = each.select(file, at.alias("channel_idx"), F.struct("a", "c").alias("place"), entry.alias("e")).groupBy(file, "channel_idx").agg(F.max_by("e", "place").alias("e"))
    return last.select(file, "channel_idx", "e.*")


def otb4_tracks(headers: DataFrame, file: str, xml: str = "xml") -> DataFrame:
    """(file, track_idx, device, gain, bits, volts, sampling_frequency, path, number_of_channels, acquisition_channel, subtitle) of lists of tracks."""
    parsed = headers.select(file, F.posexplode(F.from_xml(F.col(xml), TRACKS, OPTIONS)["TrackInfo"]).alias("track_idx", "t"))
    text = lambda tag, default: F.coalesce(F.regexp_replace(F.nullif(F.col(f"t.{tag}"), F.lit("")), C.ENDS, ""), F.lit(default))
    return parsed.select(
        file, "track_idx", text("Device", "Unknown").alias("device"), number(F.col("t.Gain"), 1.0).alias("gain"), number(F.col("t.ADC_Nbits"), 16, "int").alias("bits"), number(F.col("t.ADC_Range"), 5.0).alias("volts"),
        number(F.col("t.SamplingFrequency"), RATE).alias("sampling_frequency"), text("SignalStreamPath", "").alias("path"), number(F.col("t.NumberOfChannels"), 0, "int").alias("number_of_channels"),
        number(F.col("t.AcquisitionChannel"), 0, "int").alias("acquisition_channel"), text("SubTitle", "Unknown").alias("subtitle"),
    )


def otb4_channels(headers: DataFrame, file: str, xml: str = "xml") -> DataFrame:
    """A row for each channel of each track, in order: (file, channel_idx, track_idx, description, factor), of recordings with one stream."""
    found = track_channels(otb4_tracks(headers, file, xml), [file])
    factor = C.otb4_scale(F.lit(1.0), F.col("volts"), F.col("bits"), F.col("gain"))
    return found.select(file, "channel_idx", "track_idx", C.track_description(F.col("device"), F.col("path"), F.col("subtitle"), F.col("local_idx")).alias("description"), factor.alias("factor"))
