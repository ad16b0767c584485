"""Parcel analytics on Spark."""
