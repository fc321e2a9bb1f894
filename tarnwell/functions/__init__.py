"""tarnwell.functions"""
