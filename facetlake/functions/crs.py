"""Definition texts of reference systems that follow from their codes."""

from __future__ import annotations

# Names, ellipsoids and EPSG codes of the two datums.
_DATUMS = {
    "WGS 84": ("WGS_1984", 'SPHEROID["WGS 84",6378137,298.257223563,AUTHORITY["EPSG","7030"]],AUTHORITY["EPSG","6326"]', 4326),
    "ETRS89": ("European_Terrestrial_Reference_System_1989", 'SPHEROID["GRS 1980",6378137,298.257222101,AUTHORITY["EPSG","7019"]],AUTHORITY["EPSG","6258"]', 4258),
}


def _geographic(name: str) -> str:
    datum, rest, code = _DATUMS[name]
    return f'GEOGCS["{name}",DATUM["{datum}",{rest}],PRIMEM["Greenwich",0,AUTHORITY["EPSG","8901"]],UNIT["degree",0.0174532925199433,AUTHORITY["EPSG","9122"]],AUTHORITY["EPSG","{code}"]]'


def wkt_for_epsg(code: int) -> str | None:
    """The text of WGS 84, ETRS89 and their UTM zones; None for any other code, whose text the caller has to give."""
    for name, (_, _, own) in _DATUMS.items():
        if code == own:
            return _geographic(name)
    zones = {"N": (32600, "WGS 84", range(1, 61)), "S": (32700, "WGS 84", range(1, 61)), "E": (25800, "ETRS89", range(28, 39))}
    for half, (base, name, numbers) in zones.items():
        zone = code - base
        if zone in numbers:
            south = half == "S"
            return (
                f'PROJCS["{name} / UTM zone {zone}{"S" if south else "N"}",{_geographic(name)},PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",{6 * zone - 183}],'
                f'PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",{10000000 if south else 0}],UNIT["metre",1,AUTHORITY["EPSG","9001"]],AUTHORITY["EPSG","{code}"]]'
            )
    return None
