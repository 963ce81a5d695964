"""vistrack.plans"""
