"""Cutting lineage with written copies that outlive an executor."""

from faultline.sources.staging import shared_folder
from faultline.sources.staging import staged as cut

__all__ = ["cut", "shared_folder"]
