"""vistrack.operators"""
