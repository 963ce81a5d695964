"""vistrack.functions"""
