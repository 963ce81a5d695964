"""vistrack.streaming"""
