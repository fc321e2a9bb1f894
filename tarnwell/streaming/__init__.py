"""tarnwell.streaming"""
