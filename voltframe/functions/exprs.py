"""Column helpers: geometry, electrical formulas, strings, colours. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Resistance of a line in ohm per unit of length, and the scale of its losses (fixed values).
RESISTANCE, LOSS_SCALE = 0.4247, 1e-3
#: Parameters of the frequency formula (fixed values): droop, load response, nominal frequency.
DROOP, LOAD_RESPONSE, NOMINAL_HZ = 0.05, 0.02, 60.0
#: Named bounding boxes: north, south, east, west (fixed values).
REGIONS = {
    "NH_VT": (44.1793, 43.8583, -71.8985, -72.2598),
    "NEW_ENGLAND": (47.45, 40.94, -66.85, -73.60),
    "NE_CENTRAL": (45.01, 42.71, -71.01, -73.25),
    "MOORE_DAM": (44.353, 44.319, -71.862, -71.911),
    "MICHIGAN": (45.82, 41.80, -82.72, -86.12),
    "CT": (42.611, 40.94, -71.0, -73.60),
}
#: Fuel codes of industry descriptions (fixed values); "NOT AVAILABLE" and unknown ones are null.
FUELS = {
    "HYDROELECTRIC POWER GENERATION": "HYDRO",
    "FOSSIL FUEL ELECTRIC POWER GENERATION": "FOSSIL",
    "NUCLEAR ELECTRIC POWER GENERATION": "NUCLEAR",
    "BIOMASS ELECTRIC POWER GENERATION": "BIOMASS",
    "SOLAR ELECTRIC POWER GENERATION": "SOLAR",
    "WIND ELECTRIC POWER GENERATION": "WIND",
    "OTHER ELECTRIC POWER GENERATION": "OTHER",
}
#: Shares of a sample by fuel (fixed values).
FUEL_MIX = {"FOSSIL": 0.70, "NUCLEAR": 0.17, "HYDRO": 0.08, "BIOMASS": 0.03, "SOLAR": 0.01, "WIND": 0.01}


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Straight-line distance in the units of the coordinates."""
    return F.sqrt(square(x1, y1, x2, y2))


def square(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The square of a distance. Which of two points is nearer is told by this, as unequal squares may have equal roots."""
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def between_box(x: Column, y: Column, n: float, s: float, e: float, w: float) -> Column:
    """Within a box, edges included."""
    return x.between(w, e) & y.between(s, n)


def strictly_within(x: Column, y: Column, n: float, s: float, e: float, w: float) -> Column:
    """Within a box, edges excluded."""
    return (x > w) & (x < e) & (y > s) & (y < n)


def buffer_box(x: Column, y: Column, miles: float) -> Column:
    """Box of so many miles around a point, 60 miles to the degree."""
    d = miles / 60.0
    return F.struct((y + d).alias("n"), (y - d).alias("s"), (x + d).alias("e"), (x - d).alias("w"))


def line_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from the infinite line through two points; null if they coincide."""
    size = F.nullif(distance(x1, y1, x2, y2), F.lit(0.0))
    return F.abs((x2 - x1) * (y1 - py) - (x1 - px) * (y2 - y1)) / size


def resistance(length: Column) -> Column:
    return length * F.lit(RESISTANCE)


def power_loss(flow: Column, length: Column) -> Column:
    return flow * flow * F.lit(RESISTANCE) * length * F.lit(LOSS_SCALE)


def inverse_loss(loss: Column, length: Column) -> Column:
    """The flow that loses so much; null on a line without length."""
    return F.sqrt(loss / F.nullif(F.lit(RESISTANCE) * length * F.lit(LOSS_SCALE), F.lit(0.0)))


def marginal_loss(flow: Column, extra: Column, length: Column) -> Column:
    return F.greatest(power_loss(flow + extra, length) - power_loss(flow, length), F.lit(0.0))


def frequency_drop(load: Column, power: Column) -> Column:
    """Deviation from nominal frequency, positive with more power than load."""
    return (power - load) / (power / F.lit(NOMINAL_HZ * DROOP) + load * F.lit(LOAD_RESPONSE))


def unit_xyz(lat: Column, lon: Column) -> Column:
    """A point of the unit sphere from degrees."""
    a, o = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(a) * F.cos(o)).alias("x"), (F.cos(a) * F.sin(o)).alias("y"), F.sin(a).alias("z"))


def lat_lon(x: Column, y: Column, z: Column) -> Column:
    """Degrees of a direction; its length does not matter."""
    return F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"))


def fuel_code(naics: Column) -> Column:
    pairs = [F.lit(v) for kv in FUELS.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), F.upper(F.trim(naics)))


def number_or_zero(text: Column) -> Column:
    """Text as a number; what is none counts as zero."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def hour_stamp(ts: Column, hours: bool = True) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HH" if hours else "yyyyMMdd")


def padded(code: Column, width: int) -> Column:
    """A code with leading zeros; 'nan' if there is none."""
    return F.when(code.isNull(), F.lit("nan")).otherwise(F.lpad(code.cast("string"), width, "0"))


def tidy_name(name: Column, renamed: dict[str, str]) -> Column:
    """Trimmed, in upper case, and replaced where renamed has it."""
    clean = F.upper(F.trim(name))
    if not renamed:
        return clean
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in renamed.items() for v in kv]), clean), clean)


def query_string(**values: Column) -> Column:
    """key=value pairs joined by ampersands, in the given order."""
    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in values.items()])


def wkt_point(lon: Column, lat: Column) -> Column:
    return F.format_string("POINT(%.4f %.4f)", lon, lat)


def wkt_multipoint(points: Column) -> Column:
    """Of an array of (x, y) structs."""
    return F.concat(F.lit("MULTIPOINT("), F.array_join(F.transform(points, lambda p: F.format_string("%.4f %.4f", p.x, p.y)), ", "), F.lit(")"))


def renamed_list(names: Column, table: dict[str, str]) -> Column:
    """A comma-separated list with each name looked up; unknown ones stay."""
    known = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.array_join(F.transform(F.split(names, ","), lambda n: F.coalesce(F.try_element_at(known, n), n)), ",")


def hex_rgb(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of parts from 0 to 255."""
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("int")), 2, "0") for c in (r, g, b)]))


def rgb_of_hex(code: Column) -> Column:
    part = lambda at: F.conv(F.substring(code, at, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def rgb_of_hsl(h: Column, s: Column, lightness: Column) -> Column:
    """Parts from 0 to 255 of hue in degrees, saturation and lightness from 0 to 1."""
    c = (F.lit(1.0) - F.abs(lightness * 2 - 1)) * s

    def part(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h / 30.0, F.lit(12.0))
        a = c / 2
        return F.round((lightness - a * F.greatest(F.lit(-1.0), F.least(k - 3, F.lit(9.0) - k, F.lit(1.0)))) * 255).cast("int")

    return F.struct(part(0).alias("r"), part(8).alias("g"), part(4).alias("b"))


def hsl_of_rgb(r: Column, g: Column, b: Column) -> Column:
    r, g, b = (c / 255.0 for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = F.nullif(top - low, F.lit(0.0))
    lightness = (top + low) / 2
    h = F.when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    return F.struct(F.coalesce(h, F.lit(0.0)).alias("h"), F.coalesce(d / (F.lit(1.0) - F.abs(lightness * 2 - 1)), F.lit(0.0)).alias("s"), lightness.alias("l"))


def hash_unit(*columns: Column) -> Column:
    """Seeded pseudorandom number in [0, 1) from columns: the same wherever and whenever it is computed."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))
