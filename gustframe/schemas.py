"""Explicit schemas of every source; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _struct(spec: str) -> T.StructType:
    """Names and types, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in spec.split(","))])


#: Station registry lines, after parsing fixed-width text.
REGISTRY = _struct("station_id string, valid_from date, valid_to date, height double, latitude double, longitude double, name string, state string, variable string")
#: Clean ten-minute series of one station.
WIND_STATION = _struct("timestamp timestamp, station_id string, wind_speed double, temperature_2m double, relative_humidity double, std_v_wind double, pressure double, wind_direction double")
SOLAR_STATION = _struct("timestamp timestamp, station_id string, ghi double, dhi double, temperature_2m double, wind_speed double, precipitation_rate double, precipitation_duration double")
MASTER = _struct("station_id string, station_height double, latitude double, longitude double")
VERTICAL_WIND = _struct("starttime timestamp, forecasttime int, w_vert double")
FORECAST_WINDS = _struct("date timestamp, wind_speed_10m double, wind_speed_80m double, wind_speed_120m double, wind_speed_180m double")
REANALYSIS = _struct(
    "timestamp timestamp, u_wind_10m double, v_wind_10m double, u_wind_100m double, v_wind_100m double, wind_gust_10m double, temp_2m double, dew_point_2m double, pressure double, friction_wind double"
)
AEROSOL = _struct("timestamp timestamp, pm2_5 double, pm10 double")
GRID_FORECAST = _struct("starttime timestamp, forecasttime int, toplevel double, value double")
#: Long form of the turbine catalogue; ws_c is the wind speed in hundredths of m/s.
CURVE = _struct("turbine string, ws_c int, power_w double")
SPEC = _struct("turbine string, diameter double, cut_in double, cut_out double, rated double")
PARK = _struct("park_id string, turbine_no int, turbine string, hub_height double, rated_kw double")
COMMISSIONING = _struct("park_id string, commissioning_date date")
