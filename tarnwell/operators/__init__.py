"""tarnwell.operators"""
