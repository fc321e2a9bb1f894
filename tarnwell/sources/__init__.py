"""tarnwell.sources"""
