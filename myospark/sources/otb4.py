"""OTB4 recordings: tracks, and either one stream for all of them or a stream for each."""

from __future__ import annotations

import io
from dataclasses import dataclass
from typing import BinaryIO
from xml.etree import ElementTree

import numpy as np

from myospark.operators.layout import check_divisible
from myospark.sources.archives import Archive
from myospark.sources.recording import Decoded, logger_of, nothing

#: Fixed values of the format: the list of tracks, the device with a stream for each track, and the default rate.
TRACKS, MANY_STREAMS, RATE = "Tracks_000.xml", "Novecento+", 2000.0


@dataclass
class Track:
    device: str
    gain: float
    bits: int
    volts: float
    rate: float
    path: str
    channels: int
    acquisition_channel: int
    subtitle: str

    @property
    def factor(self) -> float:
        if self.gain == 0:
            raise ValueError(f"the gain of track {self.subtitle!r} is 0")
        return self.volts / 2.0**self.bits * 1000.0 / self.gain

    def describe(self) -> list[str]:
        return [f"{self.device}-{self.path}-{self.subtitle}-ch{c}" for c in range(self.channels)]


def text_of(parent: ElementTree.Element, tag: str, default: str | None, strip: bool = False, required: bool = False) -> str | None:
    """A child's text, or the default. If it is required, its absence is an error."""
    found = parent.find(tag)
    text = found.text if found is not None else None
    if text is None:
        if required and default is None:
            raise ValueError(f"{tag} is missing")
        return default
    return text.strip() if strip else text


def parse_tracks(xml: bytes) -> list[Track]:
    def track(e: ElementTree.Element) -> Track:
        number = lambda tag, default, kind: kind(text_of(e, tag, default))
        return Track(
            text_of(e, "Device", "Unknown", True), number("Gain", "1", float), number("ADC_Nbits", "16", int), number("ADC_Range", "5", float), number("SamplingFrequency", "2000", float),
            text_of(e, "SignalStreamPath", "", True), number("NumberOfChannels", "0", int), number("AcquisitionChannel", "0", int), text_of(e, "SubTitle", "Unknown", True),
        )

    return [track(e) for e in ElementTree.fromstring(xml).iterfind("TrackInfo")]


def one_stream(archive: Archive, tracks: list[Track]) -> Decoded:
    """The first stream's channels, in two bytes each whatever the track says, dealt to the tracks in turn."""
    if not archive.signals:
        return Decoded(RATE, 0, [], nothing)
    signal, total = archive.signals[0], sum(t.channels for t in tracks)
    if archive.size(signal) % 2:
        raise ValueError(f"{signal} ends inside a value")
    samples = check_divisible(archive.size(signal) // 2, total)
    factors = np.repeat([t.factor for t in tracks], [t.channels for t in tracks])

    def read(start: int, n: int) -> np.ndarray:
        return np.frombuffer(archive.read(signal, start * 2 * total, n * 2 * total), "<i2").reshape(n, total).T * factors[:, None]

    return Decoded(tracks[0].rate, samples, [d for t in tracks for d in t.describe()], read, ranged=archive.stored(signal))


def many_streams(archive: Archive, tracks: list[Track]) -> Decoded:
    """Four-byte streams, each with the first track that names it; all cut to the shortest and stacked."""
    by_path: dict[str, Track] = {}
    for t in tracks:
        by_path.setdefault(t.path, t)
    matched = [(s, by_path[n]) for s in archive.signals if (n := s.rsplit("/", 1)[-1]) in by_path]
    for _, t in matched:
        if t.channels < 1:
            raise ValueError(f"track {t.subtitle!r} has no channels")
        if t.gain == 0:
            raise ValueError(f"the gain of track {t.subtitle!r} is 0")
    if not matched:
        return Decoded(RATE, 0, [], nothing)
    lengths = [archive.size(s) // 4 // t.channels for s, t in matched]

    def read(start: int, n: int) -> np.ndarray:
        some = [(archive.read(s, start * 4 * t.channels, n * 4 * t.channels), t) for s, t in matched]
        return np.vstack([np.frombuffer(raw, "<i4").reshape(n, t.channels).T * t.factor for raw, t in some])

    descriptions = [d for _, t in matched for d in t.describe()]
    d = Decoded(matched[0][1].rate or RATE, min(lengths), descriptions, read, ranged=all(archive.stored(s) for s, _ in matched))
    if len({t.rate for _, t in matched}) > 1:
        d.warn(logger_of(__name__), "the tracks differ in sampling frequency; the first one's counts")
    if len(set(lengths)) > 1:
        d.warn(logger_of(__name__), f"the streams differ in length; all are cut to {min(lengths)} samples")
    return d


def decode(content: bytes | BinaryIO, header_only: bool = False) -> Decoded:
    """Only the list of tracks is read before samples are asked for."""
    archive = Archive(io.BytesIO(content) if isinstance(content, bytes) else content)
    if TRACKS not in archive:
        raise FileNotFoundError(f"the archive has no {TRACKS}")
    tracks = parse_tracks(archive.read(TRACKS))
    if not tracks:
        raise ValueError(f"{TRACKS} describes no track")
    d = (many_streams if tracks[0].device == MANY_STREAMS else one_stream)(archive, tracks)
    if header_only:
        d.read = None
    return d
