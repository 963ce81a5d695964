"""vistrack.sources"""
