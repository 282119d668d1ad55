"""Georeferenced labels and imagery to versioned COCO datasets, on Spark."""

from .operators.dataset import Dataset, create_dataset, load_dataset, save_dataset
from .plans.append import Raster, append_dataset
from .sources.geotiff import open_raster
from .sources.vector import read_labels

__all__ = ["Dataset", "Raster", "append_dataset", "create_dataset", "load_dataset", "open_raster", "read_labels", "save_dataset"]
