"""OTB+ recordings: one signal file, and a header beside it that describes adapters and their channels."""

from __future__ import annotations

import io
from dataclasses import dataclass, field
from typing import BinaryIO
from xml.etree import ElementTree

import numpy as np

from myospark.functions.columns import BITS, CHANNELS, DEVICE, RATE, SUPPLY_VOLTS
from myospark.sources.archives import Archive
from myospark.sources.recording import Decoded, logger_of


@dataclass
class Header:
    device: str
    rate: float
    bits: int
    channels: int
    gains: list[float] = field(default_factory=list)
    descriptions: list[str | None] = field(default_factory=list)
    adapter_ids: list[str | None] = field(default_factory=list)
    adapter_types: list[str | None] = field(default_factory=list)


def describe(*parts: str | None) -> str:
    """The parts that say something, trimmed, joined by hyphens."""
    given = (p.strip() for p in parts if p and p.lower() != "not defined")
    return "-".join(p for p in given if p)


def channel_total(text: str | None) -> int:
    """A number of channels that can't be read or isn't positive is the default."""
    try:
        n = int(text or "")
    except ValueError:
        return CHANNELS
    return n if n > 0 else CHANNELS


def parse_header(xml: bytes) -> Header:
    """Each channel's adapter, gain and description. Of several entries for a channel the last one counts."""
    root = ElementTree.fromstring(xml)
    h = Header(root.get("Name", DEVICE), float(root.get("SampleFrequency", RATE)), int(root.get("ad_bits", BITS)), channel_total(root.get("DeviceTotalChannels")))
    h.gains = [1.0] * h.channels
    h.descriptions, h.adapter_ids, h.adapter_types = ([None] * h.channels for _ in range(3))
    for adapter in root.iterfind("Channels/Adapter"):
        gain, first = float(adapter.get("Gain", 1)), int(adapter.get("ChannelStartIndex", 0))
        for channel in adapter.iterfind("Channel"):
            at = first + int(channel.get("Index", 0))
            if not 0 <= at < h.channels:
                raise ValueError(f"the header describes channel {at}, but there are {h.channels}")
            h.gains[at] = gain * float(channel.get("Gain", gain))
            h.adapter_ids[at] = adapter.get("ID")
            h.adapter_types[at] = adapter.get("Type", adapter.get("ID"))
            h.descriptions[at] = describe(adapter.get("ID"), adapter.get("Description"), *(channel.get(k) for k in ("ID", "Prefix", "Description", "Muscle", "Side")))
    return h


def width(bits: int) -> int:
    """Bytes of a stored number: two for 16 bits, four for all others."""
    return 2 if bits == 16 else 4


def counts(raw: bytes, channels: int, bits: int) -> np.ndarray:
    """Channels by samples."""
    return np.frombuffer(raw, f"<i{width(bits)}").reshape(-1, channels).T


def millivolts(x: np.ndarray, gains: list[float], bits: int) -> np.ndarray:
    by = np.array([g or 1.0 for g in gains])[:, None]
    return x.astype(float) * SUPPLY_VOLTS / 2.0**bits * 1000.0 / by


def decode(content: bytes | BinaryIO, header_only: bool = False) -> Decoded:
    """A partial last sample is left out. Only the header is read before samples are asked for."""
    archive = Archive(io.BytesIO(content) if isinstance(content, bytes) else content)
    if not archive.signals:
        raise FileNotFoundError("the archive has no .sig file")
    signal = archive.signals[0]
    header_file = signal[: -len(".sig")] + ".xml"
    if header_file not in archive:
        raise FileNotFoundError(f"the archive has no {header_file}")
    h = parse_header(archive.read(header_file))
    if None in h.descriptions:
        raise ValueError(f"channel {h.descriptions.index(None)} has no description")
    values, step = archive.size(signal) // width(h.bits), h.channels * width(h.bits)

    def read(start: int, n: int) -> np.ndarray:
        return millivolts(counts(archive.read(signal, start * step, n * step), h.channels, h.bits), h.gains, h.bits)

    d = Decoded(h.rate, values // h.channels, h.descriptions, None if header_only else read, ranged=archive.stored(signal))
    if values % h.channels:
        d.warn(logger_of(__name__), f"{values % h.channels} values are left over of {values} for {h.channels} channels")
    return d
