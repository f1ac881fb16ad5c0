"""Part of sectorlake."""
