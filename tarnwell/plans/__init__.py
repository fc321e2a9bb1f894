"""tarnwell.plans"""
