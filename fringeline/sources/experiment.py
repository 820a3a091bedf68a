"""Experiment descriptions: INI files as dimension tables, and importers of the text formats of a common correlator."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeline.operators.joins import dimension
from fringeline.sources.folders import merged, removed, write_parts

#: Formats of media files that there is a reader for, whatever their version.
FORMATS = ("VDIF",)
SECTIONS = "file string, section string, name string, value string"


def parse_ini(text: str) -> dict[str, dict[str, str]]:
    """Sections and exact keys; the case of keys counts."""
    parser = configparser.ConfigParser(interpolation=None, strict=False)
    parser.optionxform = str
    parser.read_string(text)
    return {s: dict(parser[s]) for s in parser.sections()}


def read_ini(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """One INI file from any store that Spark reads."""
    return parse_ini(spark.read.text(path, wholetext=True).first()[0])


def ini_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = [(p, s, k, v) for p in paths for s, values in read_ini(spark, p).items() for k, v in values.items()]
    return spark.createDataFrame(rows, SECTIONS)


def accumulation_time(text: str) -> float:
    """Seconds, as a number or a fraction of two numbers."""
    top, _, bottom = text.partition("/")
    return float(top) / float(bottom) if bottom else float(top)


def flag(text: str) -> bool:
    return text.strip().lower() in ("yes", "true", "1")


@dataclass
class Experiment:
    """Typed parameters of one experiment."""

    fft_size: int
    period: float
    mjd_start: int
    start: float
    duration: float
    window: str = "square"
    calibration: bool = False
    autos: bool = True
    cross_polarisation: bool = True
    stations: dict[str, dict] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    media: dict[str, dict] = field(default_factory=dict)
    delays: list[tuple] = field(default_factory=list)
    #: Dry and wet parts of the delays, as delays but with the part's name in front.
    atmosphere: list[tuple] = field(default_factory=list)

    @property
    def blocks(self) -> int:
        return int(-(-self.duration // self.period))


def experiment(correlation: dict, stations: dict, sources: dict, media: dict, delay_model: dict) -> Experiment:
    c, t, e = correlation["computation"], correlation["times"], correlation.get("elements", {})
    out = Experiment(int(c["FFT"]), accumulation_time(c["accumulation"]), int(t["mjd_start"]), float(t["seconds_start"]), float(t["seconds_duration"]), c.get("window", "square"), flag(c.get("phase_calibration", "no")), flag(e.get("autocorr_station", "yes")), flag(e.get("cross_polarization", "yes")))
    for name, s in stations.items():
        clock = [float(x) for x in s.get("clock_poly_us", "0:0").split(":")]
        out.stations[name] = {"id": int(s["id"]), "clock_ref": float(s.get("clock_ref", 0)), "clock_us": (clock + [0.0, 0.0])[:2]}
    out.sources = {name: int(s["id"]) for name, s in sources.items()}
    labels = {k: media.get(k, {}) for k in ("channels", "frequencies", "polarizations", "sidebands")}
    of = lambda kind, text: [labels[kind].get(x, x) for x in text.split(":")]
    for name in [f.strip() for f in media["files"]["list"].split(",")]:
        m = media[name]
        if m.get("format", "VDIF").upper() not in FORMATS:
            raise ValueError(f"{name}: format {m['format']} is not read; known are {', '.join(FORMATS)}")
        out.media[name] = m | {"channels": [int(x) for x in of("channels", m["channels"])], "polarizations": [int(x) for x in of("polarizations", m["polarizations"])], "frequencies": [float(x) for x in of("frequencies", m["frequencies"])], "sidebands": of("sidebands", m["sidebands"])}
    for name, d in delay_model.items():
        mjd, start, end, source, station = name.split("-")
        at = (int(mjd), float(start), float(end), int(source.removeprefix("so")), int(station.removeprefix("st")))
        seconds = lambda text: [float(x) * 1e-6 for x in text.replace(":", ",").split(",")][:6]
        out.delays.append((*at, seconds(d["delay_us"])))
        out.atmosphere += [(part, *at, seconds(d[f"{part}_us"])) for part in PARTS if f"{part}_us" in d]
    return out


#: Parts of a delay that files may give beside the whole.
PARTS = ("dry", "wet")
NAMES = ("correlation", "stations", "sources", "media", "delay_model")


def load(spark: SparkSession, folder: str, changes: dict[str, str] | None = None) -> Experiment:
    """The experiment of a folder's five files; changes are values by file.section.key, which replace or add to theirs."""
    files = {n: read_ini(spark, f"{folder}/{n}.ini") for n in NAMES}
    for place, value in (changes or {}).items():
        name, section, key = place.split(".", 2) if place.count(".") == 2 else (place.split(".")[0], *place.split(".", 1)[1].rsplit(".", 1))
        if name not in files:
            raise ValueError(f"{place}: no file {name}.ini")
        files[name].setdefault(section, {})[key] = value
    return experiment(*(files[n] for n in NAMES))


def block_table(spark: SparkSession, e: Experiment) -> DataFrame:
    """block, mjd and sec of the day at its start; days go on after midnight."""
    at = F.lit(e.start) + F.col("id") * e.period
    return spark.range(e.blocks).select(F.col("id").cast("int").alias("block"), (F.lit(e.mjd_start) + F.floor(at / 86400)).cast("int").alias("mjd"), F.pmod(at, F.lit(86400.0)).alias("sec"))


def described(rows: DataFrame, table: DataFrame, on: str | list[str]) -> DataFrame:
    """rows with the columns of a dimension table of the experiment; rows that it does not know are left out."""
    return rows.join(dimension(table), on)


def delay_table(spark: SparkSession, e: Experiment) -> DataFrame:
    return spark.createDataFrame(e.delays, "mjd int, start_s double, end_s double, source_id int, station int, coeffs array<double>")


def atmosphere_table(spark: SparkSession, e: Experiment) -> DataFrame:
    """The dry and wet parts of the delays, where delay_model.ini has them; they are contained in the delays."""
    return spark.createDataFrame(e.atmosphere, "part string, mjd int, start_s double, end_s double, source_id int, station int, coeffs array<double>")


def clock_table(spark: SparkSession, e: Experiment) -> DataFrame:
    rows = [(name, s["id"], s["clock_ref"], s["clock_us"][0] * 1e-6, s["clock_us"][1] * 1e-6) for name, s in e.stations.items()]
    return spark.createDataFrame(rows, "name string, station int, clock_ref double, c0 double, c1 double")


def media_table(spark: SparkSession, e: Experiment) -> DataFrame:
    """One row for each (file, index): its channel, polarisation, frequency and sideband."""
    rows = [
        (name, e.stations[m["station"]]["id"], i, c, p, f, s, float(m["f_sample"]), int(m.get("bits_sample", 2)), float(m.get("f_pcal", 0)))
        for name, m in e.media.items()
        for i, (c, p, f, s) in enumerate(zip(m["channels"], m["polarizations"], m["frequencies"], m["sidebands"], strict=True))
    ]
    return spark.createDataFrame(rows, "name string, station int, idx int, channel int, pol int, freq_hz double, sideband string, fs double, bits int, f_pcal double")


def key_values(text: str) -> list[tuple[str, str]]:
    """Lines `NAME: value` in order."""
    pairs = (line.partition(":") for line in text.splitlines())
    return [(k.strip(), v.strip()) for k, sep, v in pairs if sep]


def delays_from_im(text: str, sources: list[str] | None = None, part: str = "DELAY") -> list[tuple]:
    """(mjd, start_s, end_s, source, antenna, coefficients in microseconds) of each polynomial of a delay file: of the whole, or of its DRY or WET part."""
    values, out, scan, poly, start = key_values(text), [], {}, {}, (0, 0)
    span = next((float(v.split()[0]) for k, v in values if k.startswith("INTERVAL")), 0.0)
    for k, v in values:
        words = k.split()
        if k.endswith("POINTING SRC"):
            scan[words[1]] = v
        elif len(words) == 5 and words[2] == "POLY" and words[4] == "MJD":
            start = (int(v), 0)
        elif len(words) == 5 and words[2] == "POLY" and words[4] == "SEC":
            start = (start[0], int(v))
        elif words[-2:-1] == [part] or f"{part} (us)" in k:
            poly = {"source": words[1], "antenna": int(words[-1]) if words[-1].isdigit() else int(words[3])}
            name = scan.get(words[1], words[1])
            if sources is None or name in sources:
                out.append((start[0], float(start[1]), start[1] + span, name, poly["antenna"], [float(x) for x in v.split()]))
    return out


def sources_from_im(text: str) -> dict[str, int]:
    """Numbers of the pointing sources, in the order of their first scans."""
    out: dict[str, int] = {}
    for k, v in key_values(text):
        if k.endswith("POINTING SRC"):
            out.setdefault(v, len(out))
    return out


def stations_from_input(text: str) -> dict[str, dict]:
    """Names, numbers and clock polynomials of the telescope table."""
    out: dict[str, dict] = {}
    order: list[str] = []
    for k, v in key_values(text):
        if k.startswith("TELESCOPE NAME"):
            out[v] = {"id": int(k.split()[-1]), "clock_ref": 0.0, "clock_us": [0.0, 0.0]}
            order.append(v)
        elif k.startswith("CLOCK REF MJD") and order:
            out[order[-1]]["clock_ref"] = float(v)
        elif k.startswith("CLOCK COEFF") and order:
            n = int(k.split("/")[-1])
            if n < 2:
                out[order[-1]]["clock_us"][n] = float(v)
    return out


def correlation_from_input(text: str) -> dict[str, float]:
    """Transform size, accumulation time and scan times of the common settings."""
    names = {"NUM CHANNELS": "fft_size", "INT TIME (SEC)": "period", "START MJD": "mjd_start", "START SECONDS": "start", "EXECUTE TIME (SEC)": "duration", "FFT SPEC RES": "resolution"}
    return {names[k]: float(v) for k, v in key_values(text) if k in names}


def bands_from_input(text: str) -> list[tuple[int, float, float, str]]:
    """(number, frequency in Hz, bandwidth in Hz, sideband) of the frequency table; narrower bands than the first are zoom bands."""
    found: dict[int, dict[str, str]] = {}
    for k, v in key_values(text):
        for label, name in (("FREQ (MHZ)", "f"), ("BW (MHZ)", "bw"), ("SIDEBAND", "side")):
            if k.startswith(label) and k.split()[-1].isdigit():
                found.setdefault(int(k.split()[-1]), {})[name] = v
    return [(i, float(b["f"]) * 1e6, float(b["bw"]) * 1e6, b.get("side", "U")) for i, b in sorted(found.items())]


def streams_from_input(text: str) -> list[dict]:
    """Of each data stream: telescope number, its recorded bands as (polarisation, frequency number), sampling, tone distance in MHz and files."""
    out: list[dict] = []
    freqs: dict[int, int] = {}
    files: list[str] = []
    for k, v in key_values(text):
        words = k.split()
        if k.startswith("TELESCOPE INDEX"):
            out.append({"telescope": int(v), "bands": [], "complex": False, "f_pcal": 0.0, "files": []})
            freqs = {}
        elif k.startswith("FILE ") and len(words) == 2 and "/" in words[1]:
            files.append(v)
            i = int(words[1].split("/")[0])
            if i < len(out):
                out[i]["files"].append(v)
        elif not out:
            continue
        elif k.startswith("DATA SAMPLING"):
            out[-1]["complex"] = v.upper() == "COMPLEX"
        elif k.startswith("PHASE CAL INT"):
            out[-1]["f_pcal"] = float(v)
        elif k.startswith("REC FREQ INDEX"):
            freqs[int(words[-1])] = int(v)
        elif k.startswith("REC BAND") and "POL" in words:
            out[-1]["bands"].append([v, None])
        elif k.startswith("REC BAND") and "INDEX" in words:
            out[-1]["bands"][-1][1] = freqs[int(v)]
    return out


def ini_text(sections: dict[str, dict[str, object]]) -> str:
    """The text of an INI file; parse_ini() gives the sections again."""
    return "\n\n".join("\n".join([f"[{name}]", *(f"{k} = {v}" for k, v in values.items())]) for name, values in sections.items()) + "\n"


def correlation_ini(text: str) -> dict[str, dict[str, object]]:
    """correlation.ini of a correlator's input file."""
    c = correlation_from_input(text)
    n = len(stations_from_input(text))
    return {
        "elements": {"stations": n, "autocorr_station": "yes", "cross_polarization": "yes"},
        "computation": {"FFT": int(c.get("fft_size", 0)), "accumulation": c["period"], "window": "square", "phase_calibration": "yes" if any(s["f_pcal"] for s in streams_from_input(text)) else "no"},
        "times": {"mjd_start": int(c["mjd_start"]), "seconds_start": c["start"], "seconds_duration": c["duration"]},
    }


def stations_ini(text: str) -> dict[str, dict[str, object]]:
    return {name: {"id": s["id"], "clock_ref": s["clock_ref"], "clock_poly_us": ":".join(map(str, s["clock_us"]))} for name, s in stations_from_input(text).items()}


def sources_ini(im: str) -> dict[str, dict[str, object]]:
    return {name: {"id": i} for name, i in sources_from_im(im).items()}


def delay_model_ini(im: str, sources: list[str] | None = None) -> dict[str, dict[str, object]]:
    """delay_model.ini of a delay file: a section for each polynomial, with its dry and wet parts if the file has them."""
    numbers = sources_from_im(im)
    out: dict[str, dict[str, object]] = {}
    for key, part in (("delay_us", "DELAY"), ("dry_us", "DRY"), ("wet_us", "WET")):
        for mjd, start, end, source, antenna, c in delays_from_im(im, sources, part):
            out.setdefault(f"{mjd}-{start:g}-{end:g}-so{numbers.get(source, 0)}-st{antenna}", {})[key] = ",".join(map(repr, c))
    return out


def media_ini(text: str) -> dict[str, dict[str, object]]:
    """media.ini of a correlator's input file, with zoom bands if there are narrower bands than the first.

    All data are taken for VDIF frames; the length of frames is in their headers.
    """
    bands, stations = bands_from_input(text), {s["id"]: name for name, s in stations_from_input(text).items()}
    full = [b for b in bands if b[2] >= bands[0][2]]
    narrow = [b for b in bands if b[2] < bands[0][2]]
    streams = streams_from_input(text)
    pols = ["L", "R"] if any(p in ("L", "R") for s in streams for p, _ in s["bands"]) else ["X", "Y"]
    mhz = lambda hz: f"{hz / 1e6:g}e6"
    out: dict[str, dict[str, object]] = {"channels": {f"CH{i}": i for i, *_ in full}, "frequencies": {f"CH{i}": mhz(f) for i, f, _, _ in full}}
    if narrow:
        out["bandwidths"] = {f"CH{i}": mhz(bw) for i, _, bw, _ in full}
    out["polarizations"] = {p: j for j, p in enumerate(pols)}
    if narrow:
        out["zoom_freq"], out["zoom_bw"] = {f"ZF{i}": mhz(f) for i, f, _, _ in narrow}, {f"ZB{i}": mhz(bw) for i, _, bw, _ in narrow}
        out["zoom_post"] = {"zoom_freq": ":".join(out["zoom_freq"]), "zoom_bw": ":".join(out["zoom_bw"])}
    files = [(s, f) for s in streams for f in s["files"]]
    out["files"] = {"list": ",".join(f.rsplit("/", 1)[-1] for _, f in files)}
    of = {b[0]: b for b in bands}
    for s, f in files:
        ch = ":".join(f"CH{n}" for _, n in s["bands"])
        width = of[s["bands"][0][1]][2]
        out[f.rsplit("/", 1)[-1]] = {
            "station": stations[s["telescope"]], "channels": ch, "polarizations": ":".join(p for p, _ in s["bands"]), "framebytes": 0, "f_sample": mhz(width * (1 if s["complex"] else 2)),
            "format": "VDIF", "version": "custom", "f_pcal": f"{s['f_pcal']:g}e6", "o_pcal": "0e6", "frequencies": ch, "sidebands": ":".join(of[n][3] for _, n in s["bands"]),
        }
    return out


def imported(input_text: str, im_text: str, sources: list[str] | None = None) -> dict[str, str]:
    """The five files of an experiment, by name, from a correlator's input and delay files."""
    made = {"correlation": correlation_ini(input_text), "stations": stations_ini(input_text), "sources": sources_ini(im_text), "media": media_ini(input_text), "delay_model": delay_model_ini(im_text, sources)}
    return {name: ini_text(sections) for name, sections in made.items()}


def zoom_table(spark: SparkSession, media: dict[str, dict[str, str]]) -> DataFrame:
    """zoom, f and bw of each zoom band of media.ini."""
    post = media.get("zoom_post", {})
    value = lambda kind, label: float(media.get(kind, {}).get(label, label))
    pairs = zip(post.get("zoom_freq", "").split(":"), post.get("zoom_bw", "").split(":"), strict=True)
    rows = [(i, value("zoom_freq", f), value("zoom_bw", b)) for i, (f, b) in enumerate(pairs) if f]
    return spark.createDataFrame(rows, "zoom int, f double, bw double")


#: Keys of the generated delay table, in their order, and the columns of relative() that they hold.
DELAY_KEYS = {"a.": "q0 + k0", "r.": "rel", "f.": "f", "d0.": "d0", "d1.": "d1", "d2.": "d2", "c0.": "k0", "c1.": "k1", "z0.": "z0", "z1.": "z1", "dr.": "sec", "cr.": "age", "m.": "q0", "c.": "k0", "dd.": "delta", "si.": "model"}


def delays_ini(polys: DataFrame) -> DataFrame:
    """Rows of the generated delay table (relative() of delays.py): section, key and value, the keys ending in the epoch's second.

    a: whole delay, r: against the reference, f: the reference's own, d0 to d2: the block's polynomial, dr: its second; c0, c1:
    clock, cr: seconds since its epoch; m, c: model and clock at the block's start; z0, z1: the reference's clock; dd: how far
    the reference's delay lies from the one at the start; si: the section of delay_model.ini.
    """
    at = F.col("sec").cast("long").cast("string")
    own = polys.withColumns({c: F.lit(None).cast("string") for c in ("age", "z0", "z1", "delta", "model") if c not in polys.columns})
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("nr"), F.concat(F.lit(k), at).alias("key"), F.expr(v).cast("string").alias("value")) for i, (k, v) in enumerate(DELAY_KEYS.items()))))
    rows = own.select(F.concat(F.lit("st"), F.col("station"), F.lit("-so"), F.col("source_id")).alias("section"), F.col("sec"), pairs.alias("p"))
    return rows.select("section", "sec", "p.nr", "p.key", "p.value").where("value IS NOT NULL")


def write_delays_ini(polys: DataFrame, file: str) -> None:
    """Writes delays.ini: sections of a station and source, their blocks in order of time; the tasks write stretches of the file."""
    rows = delays_ini(polys)
    lines = rows.select("section", "sec", "nr", F.concat("key", F.lit(" = "), "value", F.lit("\n")).alias("line"))
    heads = rows.select("section").distinct().select("section", F.lit(-1.0).alias("sec"), F.lit(-1).alias("nr"), F.concat(F.lit("["), "section", F.lit("]\n")).alias("line"))
    parts = f"{file}.parts"
    write_parts(lines.unionByName(heads).withColumn("body", F.encode("line", "utf-8")), [F.col("section"), F.col("sec"), F.col("nr")], parts)
    merged(polys.sparkSession, parts, file)
    removed(polys.sparkSession, parts)
