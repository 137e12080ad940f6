"""Nearest-neighbour recommendation on Spark that stays correct as data is added and deleted."""
