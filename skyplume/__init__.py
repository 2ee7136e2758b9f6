"""Spark jobs for plume monitoring series, masks and voxels, and for training corpora."""
