"""All queries of the library over the driver tables."""

from __future__ import annotations

from skyplume.jobs import camera_jobs, colour_jobs, decision_jobs, file_jobs, geometry_jobs, image_jobs, join_jobs, light_jobs, mask_jobs, raster_jobs, reader_jobs, series_jobs, solid_jobs, station_jobs, stream_jobs, volume_jobs, wind_jobs  # noqa: F401
from skyplume.jobs.registry import ORACLE_SQL, QUERIES  # noqa: F401
